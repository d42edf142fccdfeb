import pytest

from weftgraph.functions import providers
from weftgraph.operators import extraction as E
from weftgraph.operators import joins

CHUNKS = "kg_id long, doc_id long, text string"


class Script:
    """A provider that answers by a script: extractions in turn, lines to refuse, a proposal; it notes what it is asked."""

    def __init__(self, extractions, refuse=(), proposal=None):
        self.extractions, self.refuse, self.proposal, self.calls = list(extractions), set(refuse), proposal, []

    def triples(self, text, rels=(), entities=()):
        self.calls.append(("triples", rels))
        return self.extractions.pop(0)

    def verify(self, text, lines):
        self.calls.append(("verify", len(lines)))
        return [line for line in lines if line not in self.refuse]

    def propose(self, text, lines, refused):
        self.calls.append(("propose", tuple(refused)))
        if self.proposal is None:
            raise ValueError("no answer")
        return self.proposal


def one(*args, **kw):
    model = Script(*args, **kw)
    return E.judged_lines(model, "t", ("USES",), ("概念",)), [c[0] for c in model.calls]


def test_course_of_one_text():
    none = ([], [], "kg")
    assert one([[]]) == (([], True, 1, none), ["triples"])  # nothing to judge
    assert one([["a"]]) == ((["a"], True, 1, none), ["triples", "verify"])
    assert one([["a"], ["b"]], refuse="a") == ((["b"], True, 2, none), ["triples", "verify"] * 2)
    assert one([["a"], []], refuse="a") == (([], True, 2, none), ["triples", "verify", "triples"])
    got, calls = one([["a", "c"], ["a", "c"]], refuse="a", proposal={"rel_types": ["guards"]})
    assert got == (["a", "c"], False, 2, (["GUARDS"], [], "kg")) and calls == ["triples", "verify", "triples", "verify", "propose"]
    assert one([["a"], ["a"]], refuse="a")[0] == (["a"], False, 2, none)  # proposing failed: the last extraction stands


def test_proposals_are_cleaned():
    clean = E.proposal_of
    assert clean({"rel_types": [" guards ", "GUARDS", "uses", ""], "entity_types": ["新", "概念"], "scope": "global"}, ("USES",), ("概念",)) == (["GUARDS"], ["新"], "global")
    assert clean({"rel_types": list("abcde"), "scope": "world"}, (), ()) == (["A", "B", "C"], [], "kg")
    assert clean({"rel_types": None}, (), ()) == ([], [], "kg")


@pytest.mark.parametrize("hot", [10_000, 1])
def test_refused_chunks_get_the_types_of_their_graph(spark, monkeypatch, hot):
    monkeypatch.setattr(joins, "HOT_ROWS", hot)
    rows = [(0, 1, "Ann guards Bob"), (0, 2, "Ann guards Bob and Bob sees Ann"), (0, 3, "Ann uses Bob"), (0, 4, None), (0, 5, ""), (1, 6, "Cat guards Dog, Dog uses Cat"), (None, 7, "Eve feeds Fay"), (0, 2, "Ann guards Bob and Bob sees Ann")]
    got, added = E.extract_extended(spark.createDataFrame(rows, CHUNKS), lambda: providers.language("open"), most=1)
    lines = lambda *t: "\n".join(f"{s}|概念|{r}|{v}|{o}|概念" for s, r, v, o in t)
    want = {
        1: (lines(("Ann", "GUARDS", "guards", "Bob")), False, True, ["GUARDS"]), 2: (lines(("Ann", "GUARDS", "guards", "Bob"), ("Bob", "RELATED_TO", "sees", "Ann")), False, True, ["GUARDS"]),
        3: (lines(("Ann", "USES", "uses", "Bob")), True, False, []), 4: ("", True, False, []), 5: ("", True, False, []),
        6: (lines(("Cat", "GUARDS", "guards", "Dog"), ("Dog", "USES", "uses", "Cat")), False, True, ["GUARDS"]), 7: (lines(("Eve", "FEEDS", "feeds", "Fay")), False, True, ["FEEDS"]),
    }
    found = got.collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: (r["raw"], r["accepted"], r["extended"], r["known"]) for r in found} == want
    assert sorted((str(r["kg_id"]), r["name"], r["chunks"]) for r in added.collect()) == [("0", "GUARDS", 3), ("1", "GUARDS", 1), ("None", "FEEDS", 1)]


def test_global_types_reach_all_graphs_and_failures_keep_the_last_lines(spark):
    class Model(providers.OpenRuleLanguage):
        def triples(self, text, rels=(), entities=()):
            if "broken" in text:
                raise TimeoutError("no model")
            if rels and "late" in text:
                raise TimeoutError("no second")
            return super().triples(text, rels, entities)

        def propose(self, text, lines, refused):
            if "silent" in text:
                raise ValueError("no answer")
            return super().propose(text, lines, refused) | {"scope": "global"}

    rows = [(0, 1, "Ann guards Bob"), (1, 2, "silent Cat guards Dog"), (1, 3, "late Cat guards Dog"), (1, 4, "broken")]
    got, added = E.extract_extended(spark.createDataFrame(rows, CHUNKS), Model)
    by = {r["doc_id"]: r for r in got.collect()}
    assert "|GUARDS|" in by[1]["raw"] and "|GUARDS|" in by[2]["raw"] and by[2]["extended"]
    assert "|RELATED_TO|" in by[3]["raw"] and not by[3]["extended"]
    assert (by[4]["raw"], by[4]["accepted"], by[4]["error"]) == (None, None, "TimeoutError: no model")
    assert [(r["kg_id"], r["all"], r["name"]) for r in added.collect()] == [(None, True, "GUARDS")]
    empty, none = E.extract_extended(spark.createDataFrame([], CHUNKS), Model)
    assert empty.isEmpty() and none.isEmpty()
