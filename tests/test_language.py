from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest

from treelens.errors import InvalidQuery
from treelens.lang import filters
from treelens.lang.parser import Term, parse, prefix_phrases
from treelens.sources.scopes import History, Scope, ScopeStore

NOW = datetime(2001, 8, 1, 12, tzinfo=timezone.utc)


def texts(query):
    return [[("!" if t.negated else "") + t.text for t in g] for g in parse(query)]


def test_parser():
    assert texts('report !draft | "a b" c') == [["report", "!draft"], ["a b", "c"]]
    assert texts("report |") == [["report"], []] and texts("") == [[]]
    assert texts("! !!x") == [["!", "!!x"]] and parse("!x")[0][0].negated
    assert parse('in:"/My Docs"')[0][0] == Term("in:/My Docs") and parse('"ext:pdf"')[0][0].filter() is None
    assert parse('"open | end')[0][0].text == "open | end" and parse('!"a b"')[0][0] == Term("a b", True, True)
    assert parse("EXT:pdf")[0][0].filter() == ("ext", "pdf") and parse("foo:bar")[0][0].filter() is None
    assert parse("/a/b/")[0][0].folder() == "/a/b" and parse("/a//b/")[0][0].folder() is None and parse("/a/../b/")[0][0].folder() is None
    assert prefix_phrases('unit "x') == '"unit"* """x"*'


# fixed: what the query language must refuse
@pytest.mark.parametrize("query", ["ext:", "ext:.", "size:abc", "size:10..1", "size:-1", "size:5m", "dm:2025-02-30", "dm:2025-02-01..2025-01-01", "in:relative", "type:unknown", "!file:x", "dm:2025-1-1", "size:1..2..3"])
def test_invalid_filters(query):
    with pytest.raises(InvalidQuery):
        filters.analyse(parse(query), NOW)


def test_sizes_and_dates():
    assert filters.size_of("1.5KiB") == 1536 and filters.size_of("EMPTY") == 0 and filters.size_of("2tb") == 2e12
    assert filters.size_range("..5") == filters.Range(high=5.0) and filters.size_range("!=3").inverted
    zone = ZoneInfo("America/New_York")
    day = filters.date_range("today", datetime(2025, 3, 9, 12, tzinfo=zone))
    assert day.high - day.low == 23 * 3600  # the day the clocks go forward
    month = filters.date_range("pastmonth", datetime(2025, 3, 31, 12, tzinfo=timezone.utc))
    assert datetime.fromtimestamp(month.low, timezone.utc).day == 28


def test_scope_product_is_bounded():
    scope = Scope("s", (), " | ".join(f"a{i}" for i in range(16)))
    assert len(filters.analyse(parse(" | ".join(f"b{i}" for i in range(16))), NOW, scope)) == 256
    with pytest.raises(InvalidQuery):
        filters.analyse(parse(" | ".join(f"b{i}" for i in range(17))), NOW, scope)


def test_scope_store():
    store = ScopeStore()
    one = store.save(Scope(" Work ", ("/b", "/a/", "/a"), "ext:pdf"))
    assert one.name == "Work" and one.folders == ("/a", "/b")
    for bad in (Scope("work"), Scope("All"), Scope(" "), Scope("x", ("rel",)), Scope("x", (), "size:?")):
        with pytest.raises(InvalidQuery):
            store.save(bad)
    store.save(Scope("pinned", ("/mnt/red/in/x", "/mnt/red/y", "/mnt/red", "/mnt/reddish"), is_pinned=True))
    assert [s.name for s in store.listed()] == ["pinned", "Work"]
    store.relocate({"/mnt/red": "/mnt/blue", "/mnt/red/in": "/srv/in"})
    assert store.listed()[0].folders == ("/mnt/blue", "/mnt/blue/y", "/mnt/reddish", "/srv/in/x")
    assert [s.name for s in ScopeStore(store.text()).listed()] == ["pinned", "Work"]


def test_history():
    h = History(["b", "a"])
    h.add("a")
    assert h.items == ["a", "b"] and h.older("draft") == "a" and h.older("") == "b" and h.newer() == "a" and h.newer() == "draft"
