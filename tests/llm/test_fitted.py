"""The whole results of the two fitted operators, computed plainly from what was fitted."""

import math
import re
import zlib

import pytest

from tessera.llm import quality, queries, url_filter
from tessera.llm.common import table


def walked(text):
    """Trees as nested (feature, cut, or set of categories, low, high) or a number, read from the model's own description."""
    trees, lines = [], [x for x in text.split("\n") if x.strip()]
    at = 1

    def node():
        nonlocal at
        line = lines[at].strip()
        at += 1
        if line.startswith("Predict:"):
            return float(line.split()[1])
        feature, cut = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node()
        at += 1  # Else
        return int(feature), float(cut), low, node()

    while at < len(lines):
        weight = float(re.search(r"weight ([\d.]+)", lines[at])[1])
        at += 1
        trees.append((weight, node()))
    return trees


def plain_url_features(url, known, prior):
    """known: (host, path, blocked) of the ruled URLs."""
    text = url or ""
    host, path = plain_host_and_path(url)
    n = max(len(text), 1)
    query = (re.search(r"(?s)\?([^#]*)", text) or [None, ""])[1]
    share = lambda c: text.count(c) / n
    parts = lambda h, p: (h.rsplit(".", 1)[-1], ".".join(h.split(".")[-2:]), p.removeprefix("/").split("/")[0])
    rates = []
    for k in range(3):
        same = [b for h, p, b in known if parts(h, p)[k] == parts(host, path)[k]]
        rates.append((sum(same) + prior) / (len(same) + 1))
    return [
        len(text), len(host), host.count(".") + 1, len(path), path.count("/"), sum(c in "0123456789" for c in text) / n, -sum(share(c) * math.log2(share(c)) for c in set(text)),
        query.count("&") + 1 if query else 0, len(query), int("#" in text), int(text.startswith("https://")), text.count("-"), *rates,
    ]


def plain_host_and_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :])[0]


def test_url_verdicts_equal_a_plain_walk_of_the_trees(spark, sf):
    """The whole query: rules, features and trees, computed plainly from the fitted model's description."""
    pages = table(spark, sf, "pages")
    ruled = url_filter.ruled_urls(pages)
    model, prior, _ = url_filter.learn(ruled.filter("ruled IS NOT NULL"))
    trees = walked(model.toDebugString)
    urls = {r.page_id: r.url for r in pages.collect()}
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))

    def rule(url):
        host, path = plain_host_and_path(url)
        return next(((v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), (None, None))

    known = [(*plain_host_and_path(u), rule(u)[0] == "block") for u in urls.values() if rule(u)[0]]
    assert prior == pytest.approx(sum(b for *_, b in known) / len(known)) and len(trees) == url_filter.TREES
    got = url_filter.judge(pages).collect()
    assert len(got) == len(urls) and any(r.rule is None for r in got)
    for r in got:
        verdict, said = rule(urls[r.page_id])
        assert (r.host, r.path) == plain_host_and_path(urls[r.page_id]) and r.rule == said
        if verdict is None:
            x, total = plain_url_features(urls[r.page_id], known, prior), 0.0
            for weight, t in trees:
                while isinstance(t, tuple):
                    t = t[2] if x[t[0]] <= t[1] else t[3]
                total += weight * t
            assert r.score == pytest.approx(1 / (1 + math.exp(-2 * total)), abs=1e-9)
            verdict = "block" if total >= 0 else "allow"
        assert r.verdict == verdict


def test_quality_scores_equal_a_plain_pass_of_the_network(spark, sf):
    """The whole query: folds, scores and verdicts, a document at a time."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    network = quality.learn(docs, labels)
    w, b, v, c = network.w
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.queries()["op7_quality"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        x = [min(6.0, max(-6.0, (a - m) / s)) for a, m, s in zip(quality.features(texts[r.doc_id]), network.mean, network.scale)]
        hidden = [math.tanh(sum(x[i] * w[i][j] for i in range(len(x))) + b[j]) for j in range(len(b))]
        score = 1 / (1 + math.exp(-(sum(h * v[j] for j, h in enumerate(hidden)) + c[0])))
        assert r.score == pytest.approx(score, abs=1e-9) and r.predicted == int(r.score >= quality.THRESHOLD)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
