"""Hand-worked cases of the core operators."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import routing, text
from lectern.functions.sql import Tools
from lectern.operators import chunking, events, hybrid, jsonrepair, lexical, machines, records
from lectern.sources import feeds

BODY = "Abstract\nWe test.\n\n1. Introduction\nWhy.\n\n2. Methodology\nHow.\n\n3. Results\nWhat.\n\n4. Conclusion\nSo.\n\nReferences\n[1] A."


def test_sections_in_order():
    assert [k for k, _ in chunking.sections(BODY)] == ["abstract", "introduction", "methodology", "results", "conclusion", "references"]
    assert chunking.sections("plain text") == [("general", "plain text")]
    assert chunking.sections("foo\n\nMethods\nbar")[0] == ("general", "foo")


def test_header_collisions():
    assert [k for k, _ in chunking.sections("Summary: x")] == ["conclusion"]
    assert [k for k, _ in chunking.sections("Experimental setup\nx")] == ["results"]


def test_references_and_prefix(spark):
    rows = [("p", "T", "a", BODY)]
    out = chunking.chunks(spark.createDataFrame(rows, "paper_id string, title string, abstract string, full_text string")).collect()
    assert "references" not in {r.chunk_type for r in out}
    assert [r.chunk_index for r in out] == list(range(len(out)))
    assert out[2].content.startswith("[T] ")


def test_tail_merge():
    body = "x" * 300
    assert chunking.windows(body, 2048, 200, 400) == [(body, 0, 300)]
    # windows of 100 with an overlap of 10: what is left after the second, 15 characters and the overlap, is under 30 and joins it
    assert [w[1:] for w in chunking.windows("x" * 205, 100, 10, 30)] == [(0, 100), (90, 205)]
    assert [w[1:] for w in chunking.windows("x" * 211, 100, 10, 30)] == [(0, 100), (90, 190), (180, 211)]


def test_windows_end_with_sentences():
    """Full size at 100, a fifth around it: the last end of a sentence from 82 to 120 counts."""
    ends = lambda body: [w[1:] for w in chunking.windows(body, 100, 10, 20)]
    at = lambda *places: "".join(". " if i + 2 in places else "" if i + 1 in places else "x" for i in range(200))
    assert ends(at(81)) == [(0, 100), (90, 190), (180, 200)]
    assert ends(at(82))[0] == (0, 82) and ends(at(82, 90))[0] == (0, 90) and ends(at(90, 120))[0] == (0, 120) and ends(at(121))[0] == (0, 100)
    assert chunking.windows("", 100, 10, 20) == []


def test_chunk_table(spark):
    """Every column of a paper with a title, an abstract of one piece and a body of two windows and a skipped list of references."""
    method = "Methods\n" + "We count words. " * 14  # 232 characters, 231 trimmed
    rows = [("p1", "T", "Short.", "Before.\n" + method + "\nReferences\n[1] A."), (None, "", "", "no headers"), ("p3", None, None, None)]
    out = chunking.chunks(spark.createDataFrame(rows, "paper_id string, title string, abstract string, full_text string"), 40, 10, 5)
    body = method.strip()
    cut = max(i + 2 for i in range(128, 191) if body[i : i + 2] == ". ")
    want = [
        ("p1", "title", 0, "Title: T", 2, 2.0, 0, 0),
        ("p1", "abstract", 1, "Abstract: Short.", 4, 1.8, 0, 0),
        ("p1", "general", 2, "[T] Before.", 2, 1.0, 0, 7),
        ("p1", "methodology", 3, "[T] " + body[:cut].strip(), (cut + 3) // 4, 1.2, 0, cut),
        ("p1", "methodology", 4, "[T] " + body[cut - 20 :].strip(), (4 + len(body[cut - 20 :].strip())) // 4, 1.2, cut - 20, 231),
        ("unknown", "general", 0, "no headers", 2, 1.0, 0, 10),
    ]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_windows_cover_text():
    body = "A sentence here. " * 400
    parts = chunking.windows(body, 2048, 200, 400)
    assert parts[0][1] == 0 and parts[-1][2] == len(body)
    assert all(b[1] < a[2] for a, b in zip(parts, parts[1:]))


def test_overlap_below_minimum(spark):
    with pytest.raises(ValueError):
        chunking.chunks(spark.createDataFrame([], "paper_id string, title string, abstract string, full_text string"), 512, 50, 50)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_authors(spark):
    names = F.array(*(F.lit(x) for x in "abcdef"))
    assert one(spark, text.title_entry(F.lit("T"), names)) == "Title: T by a, b, c, d, e et al."


def test_repeated_query_word(spark):
    docs = spark.createDataFrame([("1", "a b"), ("2", "b c"), ("3", "")], "paper_id string, full_text string")
    single = {r.id: r.score for r in lexical.bm25(docs, "a").collect()}
    double = {r.id: r.score for r in lexical.bm25(docs, "a a").collect()}
    assert set(single) == {"1"} and double["1"] == pytest.approx(2 * single["1"], abs=2e-6)
    assert lexical.bm25(docs, "").count() == 0
    assert lexical.bm25(docs.limit(0), "a").count() == 0


def test_rrf(spark):
    make = lambda ids: spark.createDataFrame([(i, 1.0, n) for n, i in enumerate(ids, 1)], "id string, score double, rank long")
    got = {r.id: r.rrf_score for r in hybrid.fused({"a": (make("xy"), 1.0), "b": (make("yz"), 1.0)}).collect()}
    assert got == pytest.approx({"y": 1 / 62 + 1 / 61, "x": 1 / 61, "z": 1 / 62}, abs=1e-6)


def test_rerank_parse(spark):
    assert one(spark, hybrid.parsed_scores(F.lit("0.9\nbad\n2"), F.lit(5))) == [0.9, 0.5, 1.0, 0.5, 0.5]


def test_json_repair():
    assert jsonrepair.first_object('```json\n{"a": 1}\n```') == '{"a":1}'
    assert jsonrepair.first_object('Here: {"a": "}"} bye') == '{"a":"}"}'
    assert jsonrepair.first_object('{"a": {"b": 1') == '{"a":{"b":1}}'
    assert jsonrepair.first_object("none") is None and jsonrepair.first_object(None) is None


@pytest.mark.parametrize(
    ("answer", "found"),
    [
        ("", None),
        ("  [1, 2] ", "[1,2]"),
        ('"text"', '"text"'),
        ("```\n{}\n```", "{}"),
        ('{"a": 1} {"b": 2}', '{"a":1}'),
        ('x {"a": {"b": {}}} y', '{"a":{"b":{}}}'),
        ('x {"a": "\\"}"} y', '{"a":"\\"}"}'),
        ('x {"a": "{{"', '{"a":"{{"}'),
        ('x {"a": [1, {"b": 2', None),
        ('x {"a": "open', None),
        ('x {"a": {"b": "}', None),
        ("x {a: 1} y", None),
        ('x } {"a": 1}', '{"a":1}'),
        ('x {"é": "ü"} y', '{"é":"ü"}'),
        ("x {", "{}"),
    ],
)
def test_json_repair_table(answer, found):
    assert jsonrepair.first_object(answer) == found


def test_ttl_boundaries():
    cache = machines.TtlCache()
    assert [cache.step(t, 10) for t in (0, 9, 10, 11)] == [False, True, False, True]


def test_breaker():
    breaker = machines.Breaker()
    assert [breaker.step(t, ok, 5, 60) for t, ok in ((0, False), (1, False), (2, False), (3, False), (4, False), (34, True), (64, True))][-3:] == ["open", "rejected", "closed"]


def test_progress():
    weights = {"planner": 10, "retriever": 20}
    progress = machines.Progress()
    progress.step("planner", 100, weights)
    assert progress.step("retriever", 50, weights) == 20.0


def test_durations(spark):
    assert [one(spark, text.seconds(F.lit(x))) for x in ("2m59.56s", "1m", "3s", "soon", "")] == pytest.approx([179.56, 60.0, 3.0, 60.0, 0.0])


def test_cooldowns_and_errors(spark):
    assert one(spark, routing.error_category(F.lit("HTTP 429"))) == "rate_limit"
    assert one(spark, routing.choice(F.lit("synthesis"), F.lit(100), F.lit(0.9), F.lit(1.0), F.lit("low"))) == "fast_cheap"
    assert one(spark, routing.choice(F.lit("other"), F.lit(100), F.lit(0.0), F.lit(1.0), F.lit("low"))) == "balanced"


def test_first_per_title(spark):
    rows = [("1", 1, " A "), ("2", 2, "a"), ("3", 3, ""), ("4", 4, "b")]
    got = records.first_per_title(spark.createDataFrame(rows, "paper_id string, arrival long, title string"))
    assert sorted(r.paper_id for r in got.collect()) == ["1", "4"]


def test_tools(spark):
    tools = Tools()
    tools.register("first", lambda df, n=1: df.limit(n), "the first rows")
    assert tools.invoke("first", spark.range(5), n=2).count() == 2
    assert tools.described() == {"first": "the first rows"}
    with pytest.raises(ValueError):
        tools.invoke("other")


def test_feeds_leave_out_what_is_broken(spark):
    entry = "<entry><title> A  &amp; b\n</title><summary>s</summary><id>1</id><author><name>N</name></author><author/></entry>"
    answers = [(1, f'<feed xmlns="http://www.w3.org/2005/Atom">{entry}<entry><title>no id</title><summary>s</summary></entry></feed>'), (2, "<feed><entry>"), (3, None), (4, "")]
    found = feeds.atom(spark.createDataFrame(answers, "n int, a string"), "a", "atom", "n").collect()
    assert [tuple(r) for r in found] == [(1, "A & b", "s", ["N"], "1", "atom")]
    answers = [(1, '{"data": [{"title": "t", "abstract": "a", "url": "u", "authors": [{"name": "N"}, {}]}, {"title": "", "abstract": "a", "url": "u"}]}'), (2, "{"), (3, None)]
    found = feeds.page(spark.createDataFrame(answers, "n int, a string"), "a", "json", "n").collect()
    assert [tuple(r) for r in found] == [(1, "t", "a", ["N"], "u", "json")]


def test_answers_as_lists(spark):
    answers = ['{"f": ["a", "b"]}', '{"f": "[x"}', '{"f": 0}', '{"f": "0"}', '{"f": false}', '{"f": {}}', '{"f": null}', "{}", "no json", None]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    got = [r[0] for r in rows.orderBy("i").select(text.as_list(F.col("a"), "f")).collect()]
    assert got == [["a", "b"], ["[x"], [], ["0"], [], [], [], [], [], []]


def test_provider_choice_and_counters(spark):
    asked = [("synthesis", 0.0, 1.0, None, None), ("synthesis", 0.8, 1.0, "high", None), ("format_output", 0.0, 0.0, "high", 1000), ("other", 0.1, 1.0, "low", None), ("other", 0.1, 1.0, None, 499)]
    rows = spark.createDataFrame(asked, "task string, spent double, budget double, hint string, latency int").coalesce(1)
    got = [r[0] for r in rows.select(routing.provider_choice(*(F.col(c) for c in rows.columns))).collect()]
    assert got == ["powerful", "fast_cheap", "balanced", "fast_cheap", "fast_cheap"]

    steps = [("p", 1, "paper_analyzed", None, None, 5.0), ("p", 2, "paper_analyzed", 7, 9, None), ("p", 3, "paper_analyzed", None, None, None), ("p", 4, "paper_found", None, 0, None), ("q", 1, "error", None, None, None), ("q", 2, "completed", None, None, None)]
    seen = events.counters(spark.createDataFrame(steps, "k string, at int, type string, current int, total int, progress double"), "k", ["at"])
    assert sorted(tuple(r) for r in seen.collect()) == [("p", 8, 9, 5.0), ("q", 0, None, 100.0)]
