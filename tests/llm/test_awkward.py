"""Defined results on awkward tables, for operators and for every pipeline stage."""

import hashlib

import public_tokenizers
import pytest
from conftest import SF
from test_llm import awkward, by_id, table

from lociform.llm import jaccard_join as J
from lociform.llm import lm_scoring as L
from lociform.llm import toxicity as TX
from lociform.llm.decontamination import decontaminate, find_overlap
from lociform.llm.language_id import language_id
from lociform.llm.mixing import mix
from lociform.llm.quality_classifier import quality_classifier
from lociform.llm.token_counts import token_counts
from lociform.llm.url_filters import url_filter

#: Names that operators and stages use for columns of their own.
CLASHES = ("lang_pred__", "score__", "spans", "items", "mark", "component_id", "n_shingles", "held_out", "bucket", "chance", "copies", "body_copy", "n_hit")


def crowded(spark):
    df = awkward(spark)
    for name in CLASHES:
        df = df.selectExpr("*", f"'x' as {name}")
    return df.selectExpr("*", "map('a', 1) as tags", "array(named_struct('spans', 1)) as nested")


@pytest.mark.parametrize("k", range(5))
def test_stage(spark, k):
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    docs = crowded(spark)
    empty = stage(spark, docs.limit(0), SF)
    assert empty.count() == 0
    got = stage(spark, docs, SF)
    if k < 4:
        assert got.columns == docs.columns == empty.columns
    n = got.count()
    assert n == {"decontamination": 11, "mixing": 11, "jaccard_join": 8, "quality_rules": 0}.get(name, n)
    if name == "language_id":
        assert not {1, 2, 3, 9} & {r["doc_id"] for r in got.collect()}


def test_operators_keep_their_columns_apart(spark):
    docs = crowded(spark)
    bench = spark.createDataFrame([(1, "one two three four five six", "x")], "item_id long, text string, spans string")
    for made in (language_id(docs), L.lm_score(docs), decontaminate(docs, bench), mix(docs), J.jaccard_join(docs), quality_classifier(docs)):
        assert made.count() == 11 and "lang_pred__" not in made.columns


def test_defined_results(spark):
    docs = awkward(spark)
    nothing = hashlib.sha256(b"").hexdigest()
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six"), (10, "ONE two-three")], "item_id long, text string")
    got = by_id(decontaminate(docs, bench))
    assert got[1]["n_words"] == got[1]["n_hit"] == 0 and got[1]["items_sha256"] == nothing and not got[1]["contaminated"]
    assert got[6]["n_hit"] == got[7]["n_hit"] == 6 and got[6]["n_items"] == 3 and got[6]["items_sha256"] == hashlib.sha256(b"1,10,2").hexdigest() and got[None]["contaminated"]
    got = by_id(language_id(docs))
    assert all((got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0) for k in (1, 2, 3, 9))
    got = by_id(token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")))
    assert (got[1]["n_bytes"], got[1]["n_tokens"], got[1]["over_limit"]) == (0, 0, False) and got[4]["over_limit"]
    got = by_id(L.lm_score(docs))
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 1 and got[1]["score"] == got[2]["score"] and not got[None]["held_out"]
    got = by_id(TX.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    got = by_id(mix(docs))
    assert got[1]["size"] == got[1]["taken"] == 0 and got[4]["size"] == 60_001
    got = by_id(J.jaccard_join(docs))
    assert got[1]["n_shingles"] == got[3]["n_shingles"] == 0 and got[1]["component_id"] == 1 and got[7]["component_id"] == 6


def test_benchmark_in_blocks(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    docs = docs.union(docs.limit(3))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    whole, parts = (sorted(map(tuple, decontaminate(docs, bench, block_words=n).select(columns).collect())) for n in (1_000_000, 400))
    assert whole == parts and any(r[2] for r in whole)
    tagged = docs.selectExpr("doc_id", "text", "map('a', 1) as tags")
    met = find_overlap(tagged, bench, ["doc_id", "tags"], block_words=50)
    assert met.count() == docs.count() and met.filter("size(spans) > 0").first()["tags"] == {"a": 1}


def test_benchmark_blocks_are_built_and_read_in_tasks(spark, monkeypatch):
    """Equal texts under many names, a long item, short ones and repeated rows over many blocks; the driver sees names of files alone."""
    from pyspark.sql import DataFrame

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[a : a + n]) for a, n in ((0, 13), (5, 40), (100, 3), (200, 1), (210, 150), (20, 14))]
    items = [(f"i{k}", texts[k % len(texts)]) for k in range(60)] + [("i0", texts[0]), ("i1", "another text of i1"), (None, "w7"), ("none", None), ("blank", " - ")]
    docs = [(1, " ".join(words)), (2, "x " + texts[2].upper() + " x"), (3, "w200"), (4, texts[4][:-5]), (5, None), (6, "w0 w1"), (7, "another, text of i1!")]
    bench, docs = spark.createDataFrame(items, "item_id string, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3)

    def found(block_words):
        return {r["doc_id"]: (r["n_words"], r["spans"], r["items"]) for r in find_overlap(docs, bench, ["doc_id"], block_words=block_words).collect()}

    whole = found(100_000)
    assert [k for k, r in sorted(whole.items()) if r[2]] == [1, 2, 3, 4, 7] and len(whole[1][2]) == 60 and whole[7][2] == ["i1"]
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    monkeypatch.setattr(DataFrame, "toArrow", None)
    assert all(found(n) == whole for n in (1, 30, 500))


def test_rare_languages_are_learned(spark):
    said = {"aa": "the quick brown fox and the lazy dog", "bb": "der schnelle braune fuchs und der faule hund", "cc": "zxq vkk jjw qqy zzk wvx"}
    rows = [(i, " ".join(said[x].split()[i % 3 :]) + f" {i}", x) for i in range(1_500) for x in (("cc",) if i % 60 == 0 else ("aa", "bb"))]
    docs = spark.createDataFrame([(k, t, x) for k, (_, t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    got = language_id(docs, sample_docs=40).join(docs, "doc_id").filter("held_out").collect()
    assert {r["lang"] for r in got} == set(said) and all(r["lang_pred"] == r["lang"] for r in got)
    assert not any(r["lang_pred"] == "cc" for r in language_id(docs.filter("lang <> 'cc'"), sample_docs=40).collect())


def test_shards_of_a_batch(spark, monkeypatch):
    from lociform.llm import decontamination as D

    docs = [[b"w"] * n for n in (3, 0, 5, 1, 2)]
    monkeypatch.setattr(D, "_SHARD", 4)
    assert [(s.start, s.stop) for s in D.shards(docs)] == [(0, 2), (2, 3), (3, 5)] and not list(D.shards([]))
    import numpy as np

    starts = np.array([0, 3, 3, 8, 9, 11])
    assert D.merged(np.array([0, 1, 1, 1, 1, 0, 0, 1, 1, 1, 0], bool), starts) == [[1, 3], [], [0, 2, 4, 5], [0, 1], [0, 1]]


def test_words_are_held_for_a_shard_at_a_time(monkeypatch):
    """A task of decontamination never holds the words of all texts of a batch; the result is that of one shard."""
    from lociform.llm import decontamination as D

    texts = [b"a b c d e", None, b"", b"x " * 50 + b"c d e", b"c d e", b"d e c d e"] * 20
    held, seen = [], D.Windows.spans
    monkeypatch.setattr(D.Windows, "spans", lambda self, docs: (held.append(sum(map(len, docs))), seen(self, docs))[1])
    import pyarrow as pa

    fields = D.arrow_fields(D.T.StructType.fromDDL(D.BLOCK))
    row = pa.Table.from_arrays([pa.array([v], type=f.type) for v, f in zip(D.windows_of([("i", [b"c", b"d", b"e"])]), fields, strict=True)], names=fields.names)
    (whole,) = D._judge(type("Sent", (), {"value": row}), [])(iter([texts]))
    assert len(held) == 1 and held[0] == sum(whole[0]) and whole[1][3] == [50, 53] and whole[1][5] == [2, 5] and whole[2][:3] == [["i"], [], []]
    held.clear()
    monkeypatch.setattr(D, "_SHARD", 200)
    assert list(D._judge(type("Sent", (), {"value": row}), [])(iter([texts]))) == [whole] and max(held) <= 100 < sum(held) == sum(whole[0])
    assert list(D._judge(None, [])(iter([texts]))) == [(whole[0], [[] for _ in texts], [[] for _ in texts])]


def test_runs_of_a_batch():
    import pyarrow as pa

    from lociform.llm.common import runs

    texts = [b"abc", None, b"de", b"", b"x" * 40, b"y", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.binary())], names=["k", "body"])
    got = [r.column(1).to_pylist() for r in runs(iter([batch, batch.slice(0, 0), batch.slice(2)]), 1, 4)]
    assert got == [texts[:2], texts[2:4], texts[4:5], texts[5:], texts[2:4], texts[4:5], texts[5:]]


def test_pre_tokens_are_encoded_in_a_row(monkeypatch):
    """The byte-level library gets many new pre-tokens in one string; ids, and which parts are not given back, are those of whole texts."""
    import tokenizers

    from lociform.llm import token_alignment as TA

    file, given = public_tokenizers.path("byte_bpe_50k.json"), []
    library = tokenizers.Tokenizer.from_file(file)
    library.encode_special_tokens = True

    class Counting:
        encode_special_tokens = True
        get_vocab, get_vocab_size = staticmethod(library.get_vocab), staticmethod(library.get_vocab_size)

        @staticmethod
        def encode_batch_fast(texts, **settings):
            given.extend(texts)
            return library.encode_batch_fast(texts, **settings)

    monkeypatch.setattr(tokenizers.Tokenizer, "from_file", staticmethod(lambda file: Counting))
    coder = TA.byte_level(file)
    texts = [" ".join(f"w{k}x{k * k} it's {k}%" for k in range(400)), "a  b\n c\t d \u00a0e", " \n x", "", " ", "\u00e9t\u00e9 \u4e2d\u6587 ok", "<|endoftext|> b <|endoftext|>", "e\u0301 \u0301a \U0001f600 z ", "x" * 3000 + " y"]
    want = [library.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert [list(memoryview(x).cast("i")) for x in coder(texts)] == want
    assert len(given) < 30 < len(coder.known) and not coder.wrong
    pieces = [b" a", b" b", b"b ", b"c"]
    odd = TA.Coder(pieces, lambda t: t.split(" "), lambda parts: ([{"a": 0, "b": 1, "b c": 2, "c": 3, "d": 0}[p] for p in parts], [1] * len(parts)))
    assert [x is not None for x in odd(["a b", "c a", "b", "d"])] == [True, False, True, False] and odd.wrong == {"c", "d"}


def test_language_model_tasks_take_and_give_bounded_batches(monkeypatch):
    """Texts of a batch become Python objects in runs, and counts are handed on in batches of at most _ROWS rows that add up to the same."""
    from collections import Counter

    import pyarrow as pa

    texts = [b"a few words %d of text %d" % (k, k * k) for k in range(300)] + [None, b""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array([k % 3 > 0 for k in range(302)])], names=["body", "learned"])

    def given():
        out = [list(zip(*map(list, part), strict=True)) for part in L._gather(4)(iter([batch]))]
        total = Counter()
        for part in out:
            for gram, word, n in part:
                total[gram, word] += n
        return [len(part) for part in out], total

    many, whole = given()
    assert len(many) == 2 and max(many) > 64
    taken, runs = [], L.runs
    monkeypatch.setattr(L, "_ROWS", 64)
    monkeypatch.setattr(L, "runs", lambda batches, column: (taken.append(b.num_rows) or b for b in runs(batches, column, 500)))
    few, parts = given()
    assert max(few) <= 64 and parts == whole and max(taken) < 40 and sum(taken) == 302


def test_no_checkpoint_folder_on_a_cluster():
    from types import SimpleNamespace

    from lociform.llm.common import shared_folder

    conf = {"spark.checkpoint.dir": "/shared/x"}
    session = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"), conf={"spark.sql.warehouse.dir": "/w"})
    assert shared_folder(session) == "/shared/x"
    conf.clear()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)


def test_awkward_urls(spark):
    rows = [(1, None, "x"), (None, "http://a.net/", "x"), (2, "http://x.net/" + "a/" * 50_000, "x"), (2, "http://x.net/", "x"), (3, "://", None), (4, "http://org/fr/%20", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").selectExpr("*", "'x' as path", "'x' as rule", "'x' as verdict", "1 as label", "1 as features")
    got = url_filter(pages).collect()
    assert len(got) == 6 and {(r["page_id"], r["host"], r["rule"]) for r in got} == {(1, "", None), (None, "a.net", "net/"), (2, "x.net", "net/"), (3, "", None), (4, "org", "org/fr/")}
    assert all(r["verdict"] in ("allow", "block") for r in got)
