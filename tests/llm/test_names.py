"""Columns with hostile names and types, repeated in other cases than the outputs', through every operator that carries columns."""

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalweave.llm import language_id
from evalweave.llm.common import free_name, others
from evalweave.llm.jaccard_join import distinct_documents, jaccard_groups
from evalweave.llm.mixing import mix_sources
from evalweave.llm.pieces import decode_pieces, encode_pieces
from evalweave.llm.shards import shard_documents
from evalweave.llm.url_lists import apply_lists, host_of, intervals, list_events, page_events

from .fixtures import awkward

PIECE = public_tokenizers.path("piece_bpe_32k.model")


def hostile(spark, *outputs):
    """Documents with columns named like the outputs in other cases, like the plans' own, and with marks in names."""
    docs = awkward(spark).where("doc_id is not null")
    for i, name in enumerate([*(o.upper() for o in outputs), "_metadata", "a`b", "a.b", "node", "H1", "_row", "_Key", "Words"]):
        docs = docs.withColumn(name if "`" not in name and "." not in name else "tmp", F.lit(i))
        docs = docs.withColumnRenamed("tmp", name) if name in ("a`b", "a.b") else docs
    return docs.withColumn("tags", F.create_map(F.lit("k"), F.col("doc_id")))


def ids(rows):
    return sorted(r.doc_id for r in rows.select("doc_id").collect())


@pytest.mark.parametrize(("outputs", "run"), [
    (("copy", "shuffle_key"), lambda spark, docs, path: mix_sources(docs, alpha=1.0)),
    (("lang_pred", "score"), lambda spark, docs, path: language_id.predict(docs, language_id.fit(docs))),
    (("ids", "decoded"), lambda spark, docs, path: encode_pieces(docs, PIECE, decoded_col="decoded")),
    (("ids", "decoded"), lambda spark, docs, path: decode_pieces(encode_pieces(docs, PIECE).drop("DECODED"), PIECE)),
    (("shard", "shard_bytes", "version"), lambda spark, docs, path: shard_documents(docs, path)),
    ((), lambda spark, docs, path: distinct_documents(docs.unionByName(docs))),
])
def test_columns_ride_along(spark, tmp_path, outputs, run):
    docs = hostile(spark, *outputs)
    if not outputs:
        docs = docs.drop("node")
    out = run(spark, docs, f"file://{tmp_path}/out")
    low = [c.lower() for c in out.columns]
    assert len(set(low)) == len(low) and {"a`b", "a.b", "tags", "_metadata"} <= set(out.columns)
    rows = out.select("doc_id", *[F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(out.columns)]).collect()
    assert rows and set(ids(out)) <= set(ids(docs))


def test_every_stage_with_a_map_and_repeated_rows(spark):
    docs = hostile(spark, "copy", "score", "lang_pred").unionByName(hostile(spark, "copy", "score", "lang_pred"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert out.count() <= 2 * docs.count()
    assert jaccard_groups(docs).count() == docs.count()


def test_pages_without_paths_and_keys_in_any_case(spark):
    urls = ["http://a.b.com", "https://A.b.com:8080?q=1", "http://a.b.com/", "http://a.b.com#x", "http://a.b.com/Path/x?y", "ftp://c.org", None, "no url", "http://"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("fetch_day", F.lit("2024-12-31").cast("date"))
    events = page_events(pages)
    assert {r.key for r in events.collect()} <= {"a.b.com", "b.com", "a.b.com/Path", "c.org"} and pages.select(host_of(F.col("url"))).distinct().count() == 3
    assert apply_lists(pages.withColumn("KEEP", F.lit(1)).withColumn("_metadata", F.lit(2)), events).count() == len(urls)
    upper = list_events(spark, [("spam", "A.B.com", "2024-01-01", "add"), ("spam", "a.b.COM", "2024-02-01", "remove"), ("spam", "B.Com/Path", "2024-01-01", "add"), ("spam", "b.com/path", "2024-01-01", "add")])
    assert {(r.key, str(r.valid_to)) for r in intervals(upper).collect()} == {("a.b.com", "2024-02-01"), ("b.com/Path", "None"), ("b.com/path", "None")}
    got = {r.page_id: r.keep for r in apply_lists(pages, upper).collect()}
    assert [i for i, keep in sorted(got.items()) if not keep] == [4]


def test_others_and_free_names():
    assert others(["a", "COPY", "b"], ["copy"]) == ["a", "b"] and free_name("copy", ["Copy", "copy_"]) == "copy__"


def test_long_texts_of_languages_in_pieces(monkeypatch):
    rows = {0: (language_id.Words(["eins zwei drei"]).hashes(),) * 1}
    grams = rows[0][0]
    model = language_id.Model(["de", "en"], {0: (grams, pa.array([0, 0, 1]).to_numpy(), pa.array([5.0, 3.0, 2.0]).to_numpy())}, (language_id.np.ones((language_id.LONGEST + 1, 2)) * 9))
    text = "eins unbekannt zwei\tdrei ΟΔΟΣ ΣΑΣ " * 300 + "x" * 900 + " zwei"
    whole = model.scores([text])
    monkeypatch.setattr(language_id, "PIECE", 100)
    cut = model.scores([text])
    assert whole[1].tolist() == cut[1].tolist() and abs(whole[0] - cut[0]).max() < 1e-9
    assert "".join(language_id.text_pieces(text)) == text and max(map(len, language_id.text_pieces(text))) < 1100
