import re
from pathlib import Path

from tessera.plans import registry

ROOT = Path(__file__).resolve().parent.parent


def test_every_named_query_exists_and_every_query_is_named():
    """COVERAGE.md and the registry say the same."""
    text = (ROOT / "COVERAGE.md").read_text()
    named = set(re.findall(r"`([a-z]+\d*k?_[a-z0-9_]+)`", text))
    queries = set(registry.queries())
    assert queries <= named, sorted(queries - named)
    assert {n for n in named if re.match(r"[a-z]\d+k?_", n)} <= queries | {n for n in named if n.startswith("op")}


def test_sql_is_of_registered_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())
