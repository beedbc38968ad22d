import pytest
from helpers import ids, index_of, run

from quarry.operators.ranking import PinRule, place_pins
from quarry.operators.text_score import query_tokens
from quarry.plans.params import FacetFieldNotFound, FilterFieldNotFound, InvalidGroupField, InvalidSortField, Request, SearchError, SortFieldNotFound, UnknownIndex, where_keys
from quarry.plans.search import Context


@pytest.fixture(scope="module")
def pens(spark):
    return index_of(spark, [{"id": "1", "text": "The pen is on the table"}, {"id": "2", "text": "the pen", "text2": "is on the table"}, {"id": "3", "text": "the pen"}])


@pytest.mark.parametrize("term,threshold,n", [("the pen is on the table", 0.7, 2), ("the pen is on the table", 1.0, 2), ("pen", 0.0, 3), ("pen", 1.0, 3), ("", None, 3)])
def test_threshold(pens, term, threshold, n):
    assert run(pens, {"term": term, "threshold": threshold})["count"] == n


@pytest.mark.parametrize("term,exact,n", [("christoph", True, 0), ("christoph", False, 1), ("Fox", True, 1), ("Foxes", True, 1), ("Fox", False, 2), ("", True, 0)])
def test_exact(spark, term, exact, n):
    index = index_of(spark, [{"id": "1", "text": "Christopher Nolan"}, {"id": "2", "text": "Foxes"}, {"id": "3", "text": "Fox"}])
    assert run(index, {"term": term, "exact": exact})["count"] == n


def test_tolerance(spark):
    index = index_of(spark, [{"id": "1", "text": "Main Street"}, {"id": "2", "text": "Maple Avenue"}, {"id": "3", "text": "Another Street"}])
    assert ids(run(index, {"term": "Mxin", "tolerance": 1})) == ["1"]
    assert ids(run(index, {"term": "Msple", "tolerance": 1})) == ["2"]


def test_exact_word_is_first_and_boost_grows(spark):
    index = index_of(spark, [{"id": "1", "content": "serve"}, {"id": "2", "content": "server"}])
    r = run(index, {"term": "serve"})
    assert ids(r) == ["1", "2"] and r["hits"][0]["score"] > r["hits"][1]["score"]
    scores = [run(index, {"term": "serve", "boost": {"content": b}})["hits"][0]["score"] for b in (1, 2, 5)]
    assert scores[1] / scores[0] > 1.16 and scores[2] / scores[0] > 1.29
    assert run(index, {"term": "serve", "boost": {"content": 0}})["count"] == 0


def test_multiplier(spark):
    index = index_of(spark, [{"id": str(i), "title": "word", "_omc": m} for i, m in enumerate((1, 2, 5, 10))])
    hits = run(index, {"term": "word"})["hits"]
    assert [round(h["score"] / hits[-1]["score"], 6) for h in hits] == [10, 5, 2, 1]


@pytest.fixture(scope="module")
def hundred(spark):
    return index_of(spark, [{"id": str(i), "text": "text " + "a" * (i + 1), "number": i, "bool": i % 2 == 0, "group": i % 5, "s": f"s{i % 3}"} for i in range(100)])


@pytest.mark.parametrize(
    "where,n",
    [
        ({"and": [{"bool": True}, {"number": {"gte": 50}}]}, 25), ({"or": [{"bool": True}, {"number": {"gte": 50}}]}, 75), ({"not": {"bool": True}}, 50),
        ({"number": {"between": [3, 5]}}, 3), ({"number": {"gt": 97.5}}, 2), ({"s": "s1"}, 33), ({"s": True}, 0), ({"not": {"s": True}}, 100), ({"or": []}, 0), ({"and": [{}]}, 0), ({}, 100), ({"not": {}}, 100),
    ],
)
def test_where(hundred, where, n):
    assert run(hundred, {"term": "text", "where": where})["count"] == n


def test_where_on_other_values(spark):
    docs = [{"id": "1", "text": "t", "n": [1, 5], "at": "2023-01-01", "e": "enum('even')", "p": {"lat": 9.0814233, "lon": 45.2623823}, "a": {"b": 7}}, {"id": "2", "text": "t", "n": [2], "at": "2023-01-03", "e": "enum(`odd`)", "p": {"lat": 40.0, "lon": 45.0}, "tags": ["x", "y"]}]
    index = index_of(spark, docs)
    near = {"coordinates": {"lat": 9.1418481, "lon": 45.2324096}, "unit": "km", "value": 10}
    square = [{"lat": a, "lon": b} for a, b in ((8, 44), (8, 46), (10, 46), (10, 44))]
    for where, want in [({"n": {"eq": 5}}, ["1"]), ({"at": {"gt": "2023-01-01"}}, ["2"]), ({"at": {"lt": "2023-01-02T00:00:00Z"}}, ["1"]), ({"p": {"radius": near}}, ["1"]), ({"p": {"radius": {**near, "inside": False}}}, ["2"]), ({"p": {"polygon": {"coordinates": square}}}, ["1"]), ({"a.b": {"eq": 7}}, ["1"]), ({"tags": "y"}, ["2"])]:
        assert ids(run(index, {"where": where})) == want, where
    from quarry.sources.index import Strategy

    assert ids(run(index_of(spark, docs, strategy=Strategy(explicit=True)), {"where": {"e": "even"}})) == ["1"]
    assert ids(run(index_of(spark, docs, strategy=Strategy(longest=3)), {"where": {"e": "enum('even')"}})) == []


def test_first_type_wins(spark):
    index = index_of(spark, [{"id": "1", "text": "t", "v": 3}, {"id": "2", "text": "t", "v": "3"}])
    assert ids(run(index, {"where": {"v": {"eq": 3}}})) == ["1"]
    assert run(index, {"where": {"v": "3"}})["count"] == 0


def test_errors(hundred):
    for request, error in [({"where": {"no": True}}, FilterFieldNotFound), ({"facets": {"no": {}}}, FacetFieldNotFound), ({"sortBy": {"property": "no"}}, SortFieldNotFound), ({"sortBy": {"property": "s"}}, InvalidSortField), ({"indexes": ["no"]}, UnknownIndex), ({"mode": "no"}, SearchError), ({"threshold": 2}, SearchError)]:
        with pytest.raises(error):
            run(hundred, request)
    with pytest.raises(SearchError):
        Request.of({})
    assert where_keys({"a": True, "or": [{"b": {"eq": 1}}], "not": {"c": "x"}}) == ["a", "b", "c"]


def test_facets(hundred):
    ranges = [(-10, -1), (-10, 10), (0, 10), (0.5, 10.5), (1, 100), (99, 105), (102, 105)]
    f = run(hundred, {"term": "text", "where": {"bool": True}, "facets": {"number": {"ranges": [{"from": a, "to": b} for a, b in ranges]}, "bool": {"true": True, "false": True}, "s": {}}})["facets"]
    assert f["number"]["values"] == {"-10--1": 0, "-10-10": 11, "0-10": 11, "0.5-10.5": 10, "1-100": 99, "99-105": 1, "102-105": 0} and f["number"]["count"] == 7
    assert f["bool"]["values"] == {"true": 50, "false": 50} and f["s"]["values"] == {"s0": 34, "s1": 33, "s2": 33}


def test_groups(hundred, spark):
    g = run(hundred, {"term": "text", "groupBy": {"properties": ["group", "bool"], "max_results": 3}})["groups"]
    assert len(g) == 10 and all(len(x["result"]) == 3 for x in g)
    index = index_of(spark, [{"id": "1", "title": "apple apple", "c": "food"}, {"id": "2", "title": "apple pie is long", "c": "tech"}, {"id": "3", "title": "pear", "c": "none"}])
    g = run(index, {"term": "apple", "groupBy": {"properties": ["c"]}})["groups"]
    assert [(x["values"], [h["id"] for h in x["result"]]) for x in g] == [(["food"], ["i:1"]), (["none"], []), (["tech"], ["i:2"])]
    with pytest.raises(InvalidGroupField):
        run(index_of(spark, [{"id": "1", "t": "x", "at": "2023-01-01"}]), {"groupBy": {"properties": ["at"]}})


def test_sort_over_indexes_and_pages(spark):
    make = lambda name, ps: index_of(spark, [{"id": f"d{p}", "text": "t", "priority": p} for p in ps] + [{"id": name, "text": "t"}], name)
    both = {"a": make("a", (1, 3)), "b": make("b", (2, 4))}
    r = run(both, {"term": "t", "sortBy": {"property": "priority"}})
    assert ids(r) == ["d1", "d2", "d3", "d4"] and r["count"] == 6
    assert ids(run(both, {"term": "t", "sortBy": {"property": "priority", "order": "DESC"}, "limit": 2, "offset": 1})) == ["d3", "d2"]
    assert sorted(ids(run(both, {"term": "t", "indexes": ["b"]}))) == ["b", "d2", "d4"]


def test_pins(spark):
    docs = [{"id": str(i), "c": f"c-{i}", "run": f"run-{i}"} for i in range(20)]
    index = index_of(spark, docs)
    rule = PinRule.of({"id": "r", "conditions": [{"pattern": "c", "anchoring": "is"}, {"pattern": "running", "anchoring": "is", "normalization": "stem"}], "consequence": {"promote": [{"doc_id": "5", "position": 1}, {"doc_id": "7", "position": 2}]}})
    context = Context(pins=[rule])
    assert ids(run(index, {"term": "c"}, context)) == ["0", "5", "7", "1", "2", "3", "4", "6", "8", "9"]
    assert ids(run(index, {"term": "c", "limit": 3, "offset": 2}, context)) == ["7", "1", "2"]
    grouped = index_of(spark, [{"id": str(i), "c": f"c-{i}", "odd": i % 2 == 1} for i in range(8)])
    g = run(grouped, {"term": "c", "groupBy": {"properties": ["odd"], "max_results": 3}}, context)["groups"]
    assert [(x["values"], [h["id"] for h in x["result"]]) for x in g] == [(["false"], ["i:0", "i:2", "i:4"]), (["true"], ["i:1", "i:5", "i:7"])]
    assert rule.matches("run") and not rule.matches("walk")
    assert place_pins([1, 2], [(9, 50)]) == [1, 2, 9]


def test_vectors_and_hybrid(spark):
    from quarry.sources.index import from_table

    df = spark.createDataFrame([(1, "cat here", [1.0, 0.0]), (2, "dog", [0.8, 0.6]), (3, "cat", [0.0, 1.0])], "id2 long, text string, v array<float>")
    index = from_table("v", df, "id2")
    c = Context(encoder=lambda t: [1.0, 0.0])
    assert ids(run(index, {"term": "x", "mode": "vector"}, c)) == ["1", "2"]
    assert ids(run(index, {"term": "x", "mode": "vector", "similarity": 0.9}, c)) == ["1"]
    assert ids(run(index, {"term": "cat", "mode": "hybrid"}, c))[0] == "1"
    assert ids(run(index, {"term": "cat", "mode": "auto"}, Context(choose_mode=lambda t: "fulltext"))) == ["3", "1"]
    with pytest.raises(SearchError):
        run(index, {"term": "x", "mode": "vector"})


def test_hooks_and_log(pens):
    seen = []
    c = Context(before_search=lambda r: {**r, "term": "table"}, after_search=lambda docs: docs[:1], log=seen.append)
    r = run(pens, {"term": "none", "where": {"not": {"no": True}}}, c)
    assert r["count"] == 1 == len(r["hits"]) and seen[0]["has_filters"] and not seen[0]["has_sort"]


def test_exact_is_within_prefix_and_pages_join(hundred):
    exact = run(hundred, {"term": "aaa", "exact": True, "limit": 100})
    loose = run(hundred, {"term": "aaa", "limit": 100})
    assert set(ids(exact)) <= set(ids(loose))
    assert ids(run(hundred, {"term": "text", "limit": 6})) + ids(run(hundred, {"term": "text", "limit": 6, "offset": 6})) == ids(run(hundred, {"term": "text", "limit": 12}))


def test_query_tokens():
    assert query_tokens("Foxes run", False) == ["foxes", "fox", "run"] and query_tokens("Foxes", True) == ["foxes"] and query_tokens("  ", False) == [""]
