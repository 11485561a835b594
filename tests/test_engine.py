import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspan.config import FEATURES, Settings, settings_from
from quillspan.functions import text as T
from quillspan.operators import evaluate, features, learn, models, scoring
from quillspan.operators.instances import instances, vectors
from quillspan.operators.mentions import count_mentions, mentions
from quillspan.operators.spans import sessionize, span_bounds
from quillspan.plans.commands import Workbench
from quillspan.sources import annotated, resources
from quillspan.streaming.incremental import watch_mentions

from .fixtures import GAZETTEER, MENTIONS, document


@pytest.fixture(scope="module")
def docs(tmp_path_factory):
    d = tmp_path_factory.mktemp("docs")
    for n in ("d1", "d2", "d3"):
        (d / f"{n}.txt").write_text(document(n), encoding="utf-8")
    return d


@pytest.fixture(scope="module")
def lines(spark, docs):
    return annotated.read_lines(spark, str(docs / "d1.txt")).cache()


@pytest.fixture(scope="module")
def gazetteer(spark):
    return spark.createDataFrame(GAZETTEER, "name string, code string").cache()


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()


def test_read_and_render_give_the_document_back(lines):
    rows = lines.orderBy("lineno").collect()
    assert [r.lineno for r in rows] == list(range(1, 11))
    assert rows[8].lang_name == "Old Norse" and rows[8].lang_code == "non:nrs" and rows[8].attrs["iscore"] == "0.25"
    assert rows[0].span_id is None and rows[5].text == "  ni  ka-ta " and {r.block_id for r in rows} == {"1-1", "1-2"}
    assert annotated.render(lines).first().value.rstrip("\n") == document().rstrip("\n")


def test_mentions_with_positions(lines, gazetteer):
    got = [tuple(r)[2:] for r in mentions(lines, gazetteer).orderBy("ord").collect()]
    assert got == MENTIONS
    at = {r.lineno: r.text for r in lines.collect()}
    for s, c, e, d, _, _, text in got:
        assert s != e or at[s][c:d] == text


def test_single_longest_mentions(lines, gazetteer):
    got = [tuple(r)[2:] for r in mentions(lines, gazetteer, single=True).orderBy("ord").collect()]
    # "Old Norse, Norse" is one run, of which the longest stays
    assert got == [m for m in MENTIONS if m[:3] not in ((1, 9, 1), (1, 16, 1))]


def test_case_sensitive_and_empty_input(lines, gazetteer, spark):
    assert mentions(lines, gazetteer, case_sensitive=True).count() == 0
    assert mentions(lines.where("false"), gazetteer).count() == 0
    assert mentions(lines, gazetteer.where("false")).count() == 0


def test_a_large_gazetteer_is_a_table_not_a_plan(spark, lines, gazetteer):
    many = gazetteer.unionByName(spark.range(200_000).select(F.concat(F.lit("name"), "id").alias("name"), F.lit("c").alias("code")))
    found = mentions(lines, many)
    assert [tuple(r)[2:] for r in found.orderBy("ord").collect()] == MENTIONS
    assert "name199999" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_of_mentions_grow_with_the_lines(spark, lines, gazetteer, monkeypatch, tmp_path):
    from quillspan.operators import mentions as M
    from quillspan.plans.queries import QUERIES

    monkeypatch.setattr(M, "TASK_BYTES", 64, raising=False)
    lines.write.parquet(str(tmp_path / "l"))
    found = mentions(spark.read.parquet(str(tmp_path / "l")), gazetteer)
    dealt = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x]
    assert len(dealt) == 1 and int(dealt[0].rsplit(",", 1)[1].strip(" ]")) > 8  # no later step lowers a number that is given
    assert [tuple(r)[2:] for r in found.orderBy("ord").collect()] == MENTIONS
    spark.createDataFrame([(1, "en", "a b\nOf ab"), (2, "en", "ab")], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "ab of x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    parts = QUERIES["mention_offsets"](spark, str(tmp_path))
    assert sorted(map(tuple, parts.collect())) == [(1, 1, "ab", True), (2, 1, "ab", True)]
    met = [x for x in parts._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x][0]
    assert "doc_id" in met and not re.search(r"startline#\d+L? = ", met)  # mentions are not dealt a second time


def test_a_task_of_mentions_stays_small(spark, lines, gazetteer, monkeypatch, tmp_path):
    from quillspan.operators import mentions as M

    lines.write.parquet(str(tmp_path / "l"))
    ln = spark.read.parquet(str(tmp_path / "l"))
    ln = ln.crossJoin(spark.range(1 << 14)).drop("id")  # 8 bytes each beside the lines, in the plan's estimate
    size = int(str(ln._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size > 16 << 20
    assert M.dealt(ln)._jdf.queryExecution().toRdd().getNumPartitions() == -(-size >> 20)  # a task for each MB
    short = mentions(lines, gazetteer)
    assert "collect_list" not in short._jdf.queryExecution().optimizedPlan().toString()  # no list is gathered for each word
    monkeypatch.setattr(M, "LEADS", 1)
    long = mentions(lines, gazetteer)
    assert [tuple(r)[2:] for r in short.orderBy("ord").collect()] == [tuple(r)[2:] for r in long.orderBy("ord").collect()] == MENTIONS


def test_tokens_after_odd_blanks(spark, gazetteer):
    ln = spark.createDataFrame([("d", "b", 1, "\u00a0Zulu \u3000 Zulu\x1f \u00abZulu\u00bb \x01Zulu")], "doc_id string, block_id string, lineno int, text string")
    got = sorted({(r.startcol, r.endcol, r.text) for r in mentions(ln, gazetteer).collect()})
    assert got == [(1, 5, "Zulu"), (8, 12, "Zulu"), (15, 19, "Zulu"), (22, 26, "Zulu")]


def test_no_row_for_each_token_is_sorted(spark, lines, gazetteer):
    plan = mentions(lines, gazetteer)._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[0]
    assert "pieces" not in plan and "Sort [doc_id" in plan
    assert plan.count("Window [") == 1  # that which pairs the lines; mentions are numbered where they are found


ODD = ["  Of Old Norse, Norse and Zulu of the Old Norse; Tuki-", "sano old - Norse the Zulu\u00e9", "", " - ", "-Old", "Norse- the", "- sano D\u0131n\u00e9 \u01c2dine! Tuki-sano tu-kisano", None, "\u00a0Zulu \u3000 ZULU\x1f \u00abZulu\u00bb \U0001d419ulu \ufb01 \u0301 --", "old", "norse of the", "old  norse\tof the old norse of the", "\u03a3\u0391\u03a3 sa\u0301s O\u2019old norse", "x-"]
MANY = [("old norse", "b"), ("old norse", "a"), ("norse", "non"), ("old", None), ("old", "o"), ("zulu", "zul"), ("tukisano", "tks"), ("tuki-sano", "tk2"), ("norse of the", "n3"), ("the old", "t2"), ("dine", "nav"), ("\u03c3\u03b1\u03c2", "gr"), ("sas", "s"), ("fi", "f")]


@pytest.mark.parametrize("single, case_sensitive", [(False, False), (True, False), (False, True), (True, True)])
def test_names_held_in_memory_are_found_as_by_joins(spark, monkeypatch, single, case_sensitive):
    from quillspan.operators import mentions as M

    rows = [(d, b, n, t) for d in (1, 2, None) for b in ("x", "y") for n, t in enumerate(ODD[d or 0:] if b == "y" else ODD[::-1], 100 if b == "y" else 0)]
    ln = spark.createDataFrame(rows, "doc_id int, block_id string, lineno int, text string")
    g = spark.createDataFrame(MANY, "name string, code string")
    held = sorted(map(repr, mentions(ln, g, single, case_sensitive).collect()))
    told = sorted(map(repr, M.candidates(ln, g).collect()))
    monkeypatch.setattr(M, "HELD", 3)
    assert held == sorted(map(repr, mentions(ln, g, single, case_sensitive).collect())) and len(held) > 20
    assert told == sorted(map(repr, M.candidates(ln, g).collect())) == sorted(map(repr, mentions(ln, g).select("doc_id", "name", "code").distinct().collect()))


def test_found_names_leave_in_bounded_batches(spark, monkeypatch):
    import pyarrow as pa

    from quillspan.operators import matching

    monkeypatch.setattr(matching, "BATCH", 5)
    monkeypatch.setattr(matching, "KEPT", 2)
    n = 40
    b = pa.RecordBatch.from_arrays([pa.array([i // 20 for i in range(n)]), pa.array(range(n)), pa.array([None] * n, pa.int64()), pa.array(["a b c a"] * n), pa.array([None] * n, pa.string())], ["doc_id", "lineno", "lineno2", "line1", "line2"])
    out = list(matching.finder({"a": 2, "b c": 1}, False, False)(iter([b])))
    assert max(x.num_rows for x in out) <= 5 + 2 and sum(x.num_rows for x in out) == 3 * n
    rows = [r for x in out for r in x.to_pylist()]
    assert [r["before"] for r in rows[:4]] == [0, 2, 3, 5] and rows[60]["before"] == 0 and sum(r["new"] for r in rows) == 4


def test_candidates_are_told_without_a_distinct(spark, tmp_path):
    from quillspan.plans.queries import QUERIES

    spark.createDataFrame([(1, "en", "the ab\nThe ab the"), (2, "en", "ab")], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "ab of the x"), (2, "the end")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, want in (("feat_english_word", [(1, "the", "b1", "GL-possible-english-word"), (1, "the", "b2", "GL-possible-english-word")]), ("feat_common_code", [(1, "ab", "b1", "GL-most-frequent-code"), (1, "the", "b1", "GL-most-frequent-code"), (2, "ab", "b1", "GL-most-frequent-code")])):
        df = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, df.collect())) == want
        assert not [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x and "doc_id" in x]


def test_counts_count_codes_once(lines, gazetteer):
    assert {r.name: r.n for r in count_mentions(mentions(lines, gazetteer), gazetteer).collect()} == {"old norse": 1, "norse": 3, "zulu": 3, "tukisano": 1, "dine": 2}


def test_names_are_normalized(spark, tmp_path):
    (tmp_path / "t").write_text("Á  bé (old)\tx y x\nnothing here\nab\tz\n", encoding="utf-8")
    got = sorted(map(tuple, resources.read_gazetteer(spark, str(tmp_path / "t")).collect()))
    assert got == [("a be", "x"), ("a be", "y"), ("ab", "z")]


def test_strip_accents_equals_decomposition(spark):
    samples = ["plain", "Diné Huánuco", "½ ﬁ ´ ø ñ", "éa", "Ǆ ŀ ㎏", "日本 Ωμέγα"]
    want = ["".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)) for s in samples]
    got = [r.y for r in spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, x string").select("i", T.strip_accents(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == want


@pytest.mark.parametrize("raw,core", [("(Norse),", "Norse"), ("'abc'", "'abc"), ("ǂkx'ao-'ae!", "ǂkx'ao-'ae"), ("+", "+"), ("a-", "a"), ("!Xóõ.", "!Xóõ"), ("--", "--"), ("x/y;z", "x/y"), ("=Ga", "=Ga")])
def test_core(spark, raw, core):
    assert one(spark, raw, T.core(F.col("x")))[0] == core


def test_grams(spark):
    x = F.col("x")
    assert one(spark, "ab c", T.character_ngrams(x, 1, 3))[0] == ["<", "<a", "<ab", "a", "ab", "ab>", "<", "<c", "<c>"]
    assert one(spark, "ab c", T.word_ngrams(x, 2))[0] == [["\\n", "ab"], ["ab", "c"], ["c", "\\n"]]
    assert one(spark, "a-b  c-", T.morpheme_ngrams(x, 2))[0] == [["", "a"], ["a", "b"], ["b", "c"], ["c", ""], ["", ""]]
    assert [(p.pos, p.n, p["items"]) for p in one(spark, "a b", T.contiguous(T.words(x), 2))[0]] == [(1, 1, ["a"]), (1, 2, ["a", "b"]), (2, 1, ["b"])]


def test_spans_reopen_after_a_gap(spark):
    rows = spark.createDataFrame([("d", i, s) for i, s in enumerate(["a", "a", None, "a", "b", "b", None])], "doc_id string, lineno int, span_id string")
    assert [tuple(r) for r in span_bounds(sessionize(rows)).orderBy("top").collect()] == [("d", 1, 0, 1), ("d", 2, 3, 3), ("d", 3, 4, 5)]


def test_tags_by_substring_or_strictly(spark):
    tags = spark.createDataFrame([("L",), ("T+AL",), ("*L+CR",), ("M+LN",), (None,)], "t string")
    assert [r[0] for r in tags.select(T.has_tag(F.col("t"), "L")).collect()] == [True, True, True, True, False]
    assert [r[0] for r in tags.select(T.has_tag(F.col("t"), "L", True)).collect()] == [True, False, True, False, False]


def test_windows_closest_and_ties(spark):
    m = spark.createDataFrame([("d", 8, "a", "x"), ("d", 12, "b", "y"), ("d", 12, "c", "z"), ("d", 40, "a", "x"), ("e", 12, "a", "x")], "doc_id string, startline int, name string, code string")
    sp = spark.createDataFrame([("d", 1, 20, 22)], "doc_id string, span_ord int, top int, bottom int")
    facts = spark.createDataFrame([("d", 100, 100, 3), ("e", 100, 100, 1)], "doc_id string, last_line int, num_lines int, num_names int")
    got = {(r.name, r.feature) for r in features.window_features(sp, m, facts, Settings(frequent_threshold=2)).collect()}
    assert got == {("a", "W-prev"), ("b", "W-prev"), ("c", "W-prev"), ("b", "W-closest"), ("c", "W-closest"), ("a", "W-after"), ("a", "W-closest-after")}


def test_coverage_trims_and_counts_repeats(spark):
    ln = spark.createDataFrame([("d", 1, "ka ka ta"), ("d", 2, "")], "doc_id string, lineno int, text string")
    cand = spark.createDataFrame([("d", "a", "x"), ("d", "b", "y")], "doc_id string, name string, code string")
    lm = spark.createDataFrame([("a", "x", "ka"), ("c", "z", "ta")], "name string, code string, gram string")
    got = models.coverage(ln, cand, lm, "word", 1)
    assert [tuple(r) for r in got.collect()] == [("d", 1, "a", "x", 2, 3)]
    assert sorted(r.feature for r in models.thresholds(got, "f").collect()) == [f"f>0.{i}" for i in range(1, 7)]


@pytest.mark.parametrize("kind,n,trim", [("word", 1, True), ("word", 2, False), ("morpheme", 2, False)])
def test_a_line_is_cut_into_units_once_and_not_for_each_gram(spark, kind, n, trim):
    ln = spark.createDataFrame([("d", 1, "a b c")], "doc_id string, lineno int, text string")
    for df in (models.line_grams(ln, kind, n, trim=trim), ln.select(models._counted(F.col("text"), kind, n, r"[\s\-\=\+]+").alias("g"))):
        assert df._jdf.queryExecution().analyzed().toString().count("split(") == 1
    cand = spark.createDataFrame([("d", "a", "x")], "doc_id string, name string, code string")
    lm = spark.createDataFrame([("a", "x", "b" if n == 1 else "b c")], "name string, code string, gram string")
    odd = ln.union(spark.createDataFrame([("d", 2, " "), ("d", 3, "b")], ln.schema))
    got = sorted(tuple(r)[1:] for r in models.coverage(odd, cand, lm, kind, n, trim=trim).collect())
    want = {"word1": [(1, "a", "x", 1, 3), (3, "a", "x", 1, 1)], "word2": [(1, "a", "x", 1, 4), (2, "a", "x", 0, 1), (3, "a", "x", 0, 2)], "morpheme2": [(1, "a", "x", 1, 4), (2, "a", "x", 0, 3), (3, "a", "x", 0, 2)]}
    assert got == want[f"{kind}{n}"]


def test_models_from_an_xml_collection(spark, tmp_path):
    item = lambda tag, t: f'<item id="i" tag="{tag}">{t}</item>'
    (tmp_path / "set-zul.xml").write_text(
        '<corpus xmlns:olac="http://www.language-archives.org/OLAC/1.1/"><igt id="1"><metadata><meta><subject olac:code="zul">Zulu</subject></meta></metadata><tier type="given" state="normalized">'
        + item("L", "Ab a") + item("M+L", "no") + '</tier><tier type="given" state="raw">' + item("L", "no") + "</tier></igt>"
        '<igt id="2"><metadata><meta><subject olac:code="non">Norse</subject></meta></metadata><tier type="given" state="normalized">' + item("L", "no") + "</tier></igt></corpus>", encoding="utf-8")
    ex = resources.read_example_collection(spark, str(tmp_path / "set-zul.xml"), "given")
    assert [tuple(r) for r in ex.collect()] == [("zul", "zulu", "Ab a")]
    built = {(r.kind, r.name, r.gram): r.n_times for r in models.build_models(ex).collect()}
    assert built["word", "zulu", "ab"] == 1 and built["word", None, "ab a"] == 1 and built["character", "zulu", "<Ab"] == 1 and ("word", "zulu", "Ab") not in built


def test_scores_best_and_carry_forward(spark):
    rows = spark.createDataFrame([("d", 1, 1, "a", "x", 2, ["f", "g"]), ("d", 1, 1, "b", "y", 1, ["f", "g"]), ("d", 1, 1, "c", "z", 3, [])], "doc_id string, span_ord int, lineno int, name string, code string, cand_ord int, feats array<string>")
    w = spark.createDataFrame([("f", 2.0), ("g", 1.0)], "feature string, weight double")
    s = scoring.score(rows, w, -1.0, ["doc_id", "span_ord", "lineno", "name", "code"])
    p = {r.name: round(r.p, 4) for r in s.collect()}
    assert p == {"a": 0.8808, "b": 0.8808, "c": 0.2689}
    best = scoring.best(s, ["doc_id", "span_ord", "lineno"]).first()
    assert best.name == "b" and best.scaled == 1.0  # equal scores: the first mentioned
    ln = spark.createDataFrame([("d", 1, i) for i in range(4)], "doc_id string, span_ord int, lineno int")
    said = spark.createDataFrame([("d", 1, 1, "a", "x"), ("d", 1, 3, "b", "y")], "doc_id string, span_ord int, lineno int, name string, code string")
    assert [r.name for r in scoring.carry_forward(ln, said, ["doc_id", "span_ord"]).orderBy("lineno").collect()] == [None, "a", "a", "b"]


def test_scores_work_out_instances_once(spark):
    rows = spark.createDataFrame([("d", ["f", "f2", "x"]), ("e", []), ("f", None), ("d", ["f"])], "doc_id string, feats array<string>")
    w = spark.createDataFrame([("f", 1.0), ("f", 1.0), ("f2", -1.0), (None, 9.0)], "feature string, weight double")
    s = scoring.score(rows, w, 0.0, ["doc_id"])
    assert sorted((r.doc_id, round(r.p, 4)) for r in s.collect()) == [("d", 0.7311), ("d", 0.8808), ("e", 0.5), ("f", 0.5)]
    assert s.columns == ["doc_id", "feats", "p"] and "Generate" not in s._jdf.queryExecution().optimizedPlan().toString()
    assert [r.p for r in scoring.score(rows, w.where("false"), 0.0, ["doc_id"]).collect()] == [0.5] * 4


def test_unused_features_meet_each_used_one_once(spark):
    used = spark.range(1000).select(F.lit("a").alias("feature"))
    out = learn.unused_features(spark, ("a", "b"), used)
    assert [r.feature for r in out.collect()] == ["b"]
    assert "Aggregate" in out._jdf.queryExecution().optimizedPlan().toString()


def test_training_penalises_the_bias_too(spark):
    rows = spark.createDataFrame([(["f"], True), (["f"], True), ([], False), (["g"], False)], "feats array<string>, label boolean")
    m = learn.train(rows)
    # gradient of 1/2 |w|^2 + sum of log losses is zero at the optimum
    import math

    sig = lambda z: 1 / (1 + math.exp(-z))
    f, g, b = m.weights["f"], m.weights["g"], m.weights[learn.BIAS]
    assert abs(f + 2 * (sig(f + b) - 1)) < 1e-3
    assert abs(g + sig(g + b)) < 1e-3
    assert abs(b + 2 * (sig(f + b) - 1) + sig(b) + sig(g + b)) < 1e-3
    with pytest.raises(ValueError):
        learn.train(rows.where("label"))


def test_evaluation(spark):
    truth = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y"), (4, "bafaw-balong", "z")], "k int, gold_name string, gold_code string")
    said = spark.createDataFrame([(1, "a", "x"), (2, "a", "q"), (4, "bafaw-balong", "z")], "k int, name string, code string")
    c = evaluate.compared(truth, said, ["k"])
    assert tuple(evaluate.accuracy(c).first()) == (4, 0.75, 0.5, 0.5)
    assert [tuple(r) for r in evaluate.confusion(c).collect()] == [("a", "x", "a", "q", 1)]
    assert evaluate.mention_recall(truth.where("false").withColumn("doc_id", F.lit("d")), said.withColumn("doc_id", F.lit("d"))).first().recall == 1.0
    g = spark.createDataFrame([("a", "x"), ("b", "1"), ("b", "2"), ("c", "3")], "name string, code string")
    seen = spark.createDataFrame([("A", "k:x"), ("A", "x")], "lang_name string, lang_code string")
    assert sorted(map(tuple, evaluate.common_codes(seen, g).collect())) == [("a", "x"), ("c", "3")]


def test_instances_keep_candidates_without_features(spark, lines, gazetteer):
    none = spark.createDataFrame([], "name string, code string"), spark.createDataFrame([], "word string")
    rows = instances(lines, gazetteer, *none, None, Settings(features=frozenset(["G-in-line"])))
    got = {(r.lineno, r.name, r.code): (r.label, r.feats) for r in rows.collect()}
    assert len(got) == 2 * 6  # two language lines (one by substring), six candidates
    assert got[6, "zulu", "zul"] == (True, ["G-in-line"]) and got[6, "dine", "nav"] == (False, [])
    assert not any(label for (n, *_), (label, _) in got.items() if n == 9)  # a code with a colon never matches
    assert vectors(rows).where("value like '%-6-old_norse-non: %'").count() == 1


def test_settings(tmp_path):
    (tmp_path / "c.ini").write_text("[locations]\ndir = /x\nlanguage-table = %(dir)s/t\n[parameters]\nwindow-size = 7\nsingle-longest-mention = yes\nmention-capitalization = title\n[features]\nW-prev = yes\nW-close = no\n")
    s, places = settings_from(str(tmp_path / "c.ini"))
    assert s.window_size == 7 and s.single_mention and not s.case_sensitive and s.on("W-prev") and not s.on("W-close") and places["language-table"] == "/x/t"
    assert settings_from(None)[0] == Settings() and len(FEATURES) == 26


def test_train_classify_and_test(spark, docs, gazetteer, tmp_path):
    resources.write_gazetteer(gazetteer, str(tmp_path / "g"))
    w = Workbench(spark, Settings(), {"language-table": str(tmp_path / "g")})
    files = [str(docs / f"d{i}.txt") for i in (1, 2, 3)]
    w.train(files[:2], str(tmp_path / "m"), str(tmp_path / "v"))
    acc = w.test(files[2:], str(tmp_path / "m"))["accuracy"].first()
    assert acc.samples == 2 and acc.acc_name >= 0.5
    w.classify(files[2:], str(tmp_path / "m"), str(tmp_path / "out"))
    got = annotated.read_documents(spark, str(tmp_path / "out"))
    assert got.where("lineno in (6, 7) and lang_name = 'Zulu' and lang_code in ('zul', 'zux')").count() == 2
    assert got.count() == 10
    assert annotated.export_documents(spark, str(tmp_path / "out"), str(tmp_path / "plain")) == 1
    assert annotated.read_lines(spark, str(tmp_path / "plain/d3.txt")).count() == 10
    w.close()
    with pytest.raises(ValueError):
        w.lines([])


def test_a_stream_of_new_files(spark, docs, gazetteer, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n in ("d1", "d2"):
        (src / f"{n}.txt").write_text(document(n), encoding="utf-8")
        watch_mentions(spark, str(src), str(tmp_path / "c"), gazetteer, str(tmp_path / "o")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o"))
    assert {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {"d1": len(MENTIONS), "d2": len(MENTIONS)}


def test_download_skips_what_fails(tmp_path):
    (tmp_path / "i.csv").write_text("c,1,2,3,4,5,6,7,iso\naa,,,,,,,,aaa\n", encoding="utf-8")

    def fetch(url, timeout):
        assert url == "http://example.org/aa.zip"
        raise TimeoutError("late")

    assert resources.download_web_models(str(tmp_path / "i.csv"), "http://example.org/", str(tmp_path / "o"), fetch=fetch) == [("aa", "skipped: late")]


def test_commands_print_their_results(spark, docs, gazetteer, tmp_path, capsys, monkeypatch):
    from quillspan import cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    resources.write_gazetteer(gazetteer, str(tmp_path / "g"))
    learn.save(learn.Model({"W-prev": 0.5, "L-in-line": -1.0, learn.BIAS: 0.25}), spark, str(tmp_path / "m"))
    (tmp_path / "c.ini").write_text(f"[locations]\nlanguage-table = {tmp_path}/g\n[features]\nW-prev = yes\nW-close = yes\n")
    run = lambda *a: (cli.main([a[0], str(tmp_path / "c.ini"), *a[1:]]), capsys.readouterr().out.splitlines())[1]
    one = str(docs / "d1.txt")
    assert run("list-mentions", one) == ["\t".join(map(str, m)) for m in MENTIONS]
    assert run("count-mentions", one) == ["norse: 3", "zulu: 3", "dine: 2", "old norse: 1", "tukisano: 1"]
    assert "zulu\tzul" in run("find-common-codes", one)
    assert run("list-model-weights", "--model", str(tmp_path / "m")) == ["W-prev\t0.5", "(bias)\t0.25", "L-in-line\t-1.0", "W-close"]


def test_models_are_read_from_files(spark, gazetteer, tmp_path):
    resources.write_gazetteer(gazetteer, str(tmp_path / "g"))
    lm, web = tmp_path / "lm", tmp_path / "web"
    lm.mkdir()
    (web / "zul_dir").mkdir(parents=True)
    (lm / "non_old norse.char").write_text("<ab\t3\nb\t1\n", encoding="utf-8")
    (lm / "non_old norse.word").write_text("ka ta\t2\n", encoding="utf-8")
    (lm / "zul.morph").write_text("ka\t2\n", encoding="utf-8")
    (lm / "zul_unknown name.word").write_text("no\t2\n", encoding="utf-8")
    (web / "zul_dir/zul-chartrigrams.txt").write_text("<um 12\nbad\n", encoding="utf-8")
    (web / "zul_dir/zul-words.txt").write_text("umuntu 3\n", encoding="utf-8")
    (tmp_path / "i.csv").write_text("name,iso,dir\nZulu,zul,zul_dir\n", encoding="utf-8")
    w = Workbench(spark, Settings(), {"language-table": str(tmp_path / "g"), "own-language-model": str(lm), "far-language-model": str(web), "far-directory-index": str(tmp_path / "i.csv")})
    got = {tuple(r) for r in w.models().collect()}
    assert got == {("field", "character", "old norse", "non", 3, "<ab"), ("field", "character", "old norse", "non", 1, "b"), ("field", "word", "old norse", "non", 2, "ka ta"), ("field", "morpheme", None, "zul", 1, "ka"),
                   ("web", "character", "zulu", "zul", 3, "<um"), ("web", "word", "zulu", "zul", 1, "umuntu")}
