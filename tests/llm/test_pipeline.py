"""Each stage of the pipeline against a plain version on what it gets, and cases planted in its input."""

import re

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_dedup import exact, near
from tests.llm.test_texts import check_packing

ITEM = "The grower in Sevilla sells 12 boxes of figs to Marta and 30 boxes of dates to Pedro before the fair opens in May"


def planted(spark):
    """The small documents with copies, near copies, a benchmark passage in other words, and repeated rows."""
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long = [d for d in docs if 1000 < len(d["text"]) < 4000 and "###" not in d["text"] and "|" not in d["text"]][:6]
    more = []
    for i, d in enumerate(long):
        more.append(d | {"doc_id": 900_000 + i, "text": d["text"].replace(" ", "  ", 3) + "\n"})
        more.append(d | {"doc_id": 910_000 + i, "text": d["text"] + " ende"})
    asked = ITEM.replace("12", "7").replace("30", "18").replace("Marta", "Lucia").replace("Pedro", "Jorge")
    more.append(long[0] | {"doc_id": 920_000, "text": long[0]["text"][::-1] + "\n" + asked})
    more += [docs[0], long[1] | {"doc_id": None, "text": "a row without an id " * 30}, long[1] | {"doc_id": 930_000, "text": None}]
    return spark.createDataFrame([tuple(d[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for d in docs + more], "doc_id long, text string, lang string, source string, n_chars long")


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.createDataFrame([(10_000, ITEM)], "item_id long, text string").write.mode("append").parquet(f"{tmp_path}/benchmark.parquet")
    docs, held = planted(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        held[name] = (docs, out)
        if name != "packing":
            assert out.columns == docs.columns
        docs = out

    before, after = map(rows, held["quality"])
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean, left = {i for i, _ in before if labels.get(i) == (1, 0)}, {i for i, _ in after}
    assert len(clean & left) > 0.95 * len(clean)

    before, after = map(rows, held["exact"])
    want = exact(before)
    assert sorted(i for i, _ in after if i is not None) == sorted({i for (i, _), v in ((k, want[k]) for k in before if k[0] is not None) if v[0] == i})

    before, after = ([x for x in rows(d) if x[0] is not None] for d in held["near"])
    assert sorted(i for i, _ in after) == sorted(i for i, (_, c) in near(before).items() if i == c)

    before, after = map(rows, held["decontaminated"])
    gone = {i for i, _ in before} - {i for i, _ in after}
    words = lambda x: f" {' '.join(re.sub(r'[^\w\s]', ' ', (x or '').lower()).split())} "
    items = [words(r.text) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    assert {i for i, t in before if any(x in words(t) for x in items)} <= gone and (920_000 in gone or 920_000 not in {i for i, _ in before})

    before, pieces = held["packing"]
    assert check_packing(pieces.collect(), dict(rows(before))) < 4 * 1024


def test_run_names_every_document_that_is_left(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 1024").count() == 0 and out.count() > 50


def test_stages_of_nothing_and_of_clashing_columns(spark):
    """Columns that documents doesn't name pass through every stage, also under names that the operators use."""
    row = (1, "one two three four five six " * 9, "en", "s", 5, "mine", "yes", 7, "k", [1])
    kind = "doc_id long, text string, lang string, source string, n_chars long, quality string, kept string, component_id int, digest string, item_ids array<int>"
    docs = spark.createDataFrame([row, row, (None, None, None, None, None, None, None, None, None, None), (2, "", "en", "s", 0, "q", "no", 1, "d", [])], kind)
    for name, stage in corpus_pipeline.STAGES:
        some, none = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
        assert none.count() == 0
        if name != "packing":
            assert some.columns == docs.columns and some.schema == docs.schema
            assert {r.quality for r in some.collect()} <= {"mine", "q", None}
