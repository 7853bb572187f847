import hashlib

import public_tokenizers
import sentencepiece

import corpus_pipeline
from evalweave.llm.mixing import mix_sources

from .fixtures import DOC, awkward
from .test_joins import brute
from .test_scans import LANGS

PIECE = public_tokenizers.path("piece_bpe_32k.model")


def test_pipeline_against_brute_force(spark, tmp_path):
    words = {k: " ".join(v) for k, v in LANGS.items()}
    rows = [(i, f"{words['aa']} n{i} {words['aa']}", "aa", "s1", 0) for i in range(100, 140)] + [(i, f"{words['bb']} m{i}", "bb", "s2", 0) for i in range(200, 230)]
    rows += [(i, f"{' '.join(words['aa'].split() * 8)} {' '.join(f'o{i // 2}{k}' for k in range(40))} {i}", "aa", "s2", 0) for i in range(300, 310)]
    rows += [(1, "1 2 3", "aa", "s1", 0), (2, None, "bb", "s1", 0), (3, rows[0][1], "aa", "s2", 0), (None, f"{words['aa']} alone", "aa", "s1", 0), (5, rows[1][1], "aa", "s1", 0), (5, rows[1][1], "aa", "s1", 0)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    spoken = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    group = brute([(r[0], r[1]) for r in spoken], 80, 5)
    kept = {r for r in spoken if r[0] is None or group[r[0]][1] == r[0]}
    assert 3 in {r[0] for r in kept} and 100 not in {r[0] for r in kept} and len([r for r in kept if r[0] == 5]) == 1
    mixed = mix_sources(spark.createDataFrame(sorted(kept, key=str), DOC)).collect()
    library, want = sentencepiece.SentencePieceProcessor(model_file=PIECE), []
    for r in mixed:
        ids = [*library.encode(r.text), library.eos_id()]
        want.append((str(r.doc_id), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), len(ids)))
    assert got == sorted(want)


def test_stages_keep_the_columns_of_documents(spark):
    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.dtypes == awkward(spark).dtypes


def test_near_copies_at_five_words_and_eight_in_ten_go(spark):
    base = [f"w{i}" for i in range(100)]
    one, two = [w if i != 50 else "x" for i, w in enumerate(base)], [w if i not in (30, 70) else "x" for i, w in enumerate(base)]
    inner = [w if i not in (20, 50, 80) else "y" for i, w in enumerate(base)]
    texts = {1: base, 2: one, 3: two, 4: inner, 5: [f"z{i}" for i in range(100)]}
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in texts.items()], DOC)
    sets = {i: {tuple(t[k : k + 5]) for k in range(96)} for i, t in texts.items()}
    assert [100 * len(sets[1] & sets[i]) >= 80 * len(sets[1] | sets[i]) for i in (2, 3, 4, 5)] == [True, True, False, False]
    assert {i: g for i, (_, g) in brute([(i, " ".join(t)) for i, t in texts.items()]).items()}[3] == 3
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 4, 5]
