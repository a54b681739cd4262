"""SimHash, token alignment and spelling variants against brute force, and on awkward tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import SF
from test_llm import awkward

from lociform.llm import jaccard_join as J
from lociform.llm import simhash_dedup as S
from lociform.llm import spelling_variants as S13
from lociform.llm import token_alignment as TA
from lociform.llm.common import table


def components(linked: np.ndarray) -> np.ndarray:
    """The least index that each row reaches in a matrix of links."""
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(linked)).min(axis=1)
        if (least == label).all():
            return label
        label = least


def majority(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def deduplicated(rows):
    """(key, fingerprint, component_id) of (key, text) by comparing all pairs."""
    prints = np.array([majority(t) for _, t in rows], np.uint64)
    label = components(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3)
    keys = [[k for (k, _), x in zip(rows, label, strict=True) if x == y and k is not None] for y in label]
    return sorted(((k, f"{p:016x}", min(own, default=None)) for (k, _), p, own in zip(rows, prints.tolist(), keys, strict=True)), key=str)


def by_operator(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)


def near_copies(rng, groups=12, copies=12):
    """Texts of 400 words, each with copies in which a few words differ."""
    out = []
    for g in range(groups):
        words = [f"w{x}" for x in rng.integers(0, 900, 400)]
        for c in range(copies):
            own = words.copy()
            for at in rng.integers(0, 400, c // 3):
                own[at] = f"x{g}{c}"
            out.append((len(out) * 7 % 1_000, " ".join(own)))
    return out


@pytest.mark.parametrize("cell_sets", [8_192, 3])
def test_simhash_equals_brute_force(spark, cell_sets):
    rng = np.random.default_rng(5)
    rows = [(r[0], r[1]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()] + near_copies(rng) + [(None, None), (None, "alone here"), (5, ""), (3, " \t"), (9, "one two"), (9, "ONE two")]
    want = deduplicated(rows)
    assert len({w[2] for w in want}) < len({w[1] for w in want}) - 20  # links, not only equal fingerprints
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert by_operator(S.simhash_dedup(docs, cell_sets=cell_sets)) == want


@pytest.mark.parametrize("errors", [1, 3])
def test_links_of_dense_fingerprints_at_every_level(spark, errors):
    """Cells so small that fingerprints go down all levels."""
    rng = np.random.default_rng(errors)
    made = set()
    for base in rng.integers(-(1 << 63), 1 << 63, 8, dtype=np.int64).tolist():
        for _ in range(60):
            v = base & (1 << 64) - 1
            for bit in rng.integers(0, 64, rng.integers(0, 3 * errors)).tolist():
                v ^= 1 << bit
            made.add(v)
    prints = np.array(sorted(made), np.uint64)
    label = components(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= errors)
    signed = prints.view(np.int64)
    groups = collections.defaultdict(set)
    for p, x in zip(signed.tolist(), label.tolist(), strict=True):
        groups[x].add(p)
    want = {(p, min(g)) for g in groups.values() if len(g) > 1 for p in g}
    rows = spark.createDataFrame([(int(p),) for p in signed], "fp long")
    assert {tuple(r) for r in S.fingerprint_links(rows, errors, cell_sets=2).collect()} == want


def test_tries_of_many_cells():
    rng = np.random.default_rng(1)
    cells = np.repeat(np.arange(40, dtype=np.uint64), 30) << np.uint64(48)
    keys = np.unique(cells | (rng.integers(0, 4, 1_200, dtype=np.uint64) << np.uint64(20)) | rng.integers(0, 1 << 9, 1_200, dtype=np.uint64))
    linked = (np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 3) & (keys[:, None] >> np.uint64(48) == keys[None, :] >> np.uint64(48))
    assert (S.Tries(keys, 48).labels(3) == components(linked)).all()


def test_simhash_of_awkward_tables(spark):
    docs = awkward(spark).selectExpr("*", "'x' as fp", "'x' as fingerprint", "'x' as component_id", "map('a', 1) as tags")
    got = S.simhash_dedup(docs)
    assert got.count() == 11 and S.simhash_dedup(docs.limit(0)).count() == 0
    found = {r["doc_id"]: r for r in got.collect()}
    assert [found[k]["fingerprint"] for k in (1, 2, 3)] == ["0" * 16] * 3 and {found[k]["component_id"] for k in (1, 2, 3)} == {1}
    assert found[7]["component_id"] == found[None]["component_id"] == 6  # the same words in other letters; a null key is never an id
    with pytest.raises(ValueError):
        S.fingerprint_links(spark.createDataFrame([(1,)], "fp long"), errors=5)


def variants(rows, least_length=5, least_count=3):
    """word: (form, root, n, n_near, form_n), by all edits of every word."""
    seen = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            seen[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in seen.items() if len(w) >= least_length and n >= least_count}
    letters = sorted({c for w in words for c in w})
    found = {}
    for w, n in words.items():
        ends = [(w[:k], w[k:]) for k in range(len(w) + 1)]
        edits = {a + b[1:] for a, b in ends if b} | {a + c + b[1:] for a, b in ends if b for c in letters} | {a + c + b for a, b in ends for c in letters}
        near = sorted((x for x in edits & words.keys() if x != w), key=lambda x: (-words[x], x))
        is_form = bool(near) and words[near[0]] >= 2 * n
        found[w] = [near[0] if is_form else None, w, n, len(near), words[near[0]] if is_form else None]
    for w, own in found.items():
        while found[own[1]][0] is not None:
            own[1] = found[own[1]][0]
    return {w: tuple(x) for w, x in found.items()}


def told(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("block_words", [400, 1])
def test_variants_equal_brute_force(spark, block_words):
    """Also with blocks so small that all are subdivided to the last."""
    rng = np.random.default_rng(2)
    stems = ["aaaaa", "banana", "anagram", "élèves", "repetition", "zz" * 40, "x" * 300]
    made = []
    for stem in stems:
        for _ in range(25):
            at, kind, letter = int(rng.integers(len(stem))), rng.integers(3), "abzÿ"[rng.integers(4)]
            word = [stem[:at] + stem[at + 1 :], stem[:at] + letter + stem[at + 1 :], stem[:at] + letter + stem[at:]][kind]
            made += [word] * int(rng.integers(1, 9))
        made += [stem] * 40 + [stem.upper()] * 3
    rows = [(r[0], r[1]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    rows += [(i, ", ".join(made[i::50])) for i in range(50)] + [(None, "Kettles kettles kettles kettle"), (None, None), (7, ""), (8, "1 2 ab")] * 2
    want = variants(rows)
    assert sum(w[0] is not None for w in want.values()) > 30 and any(w[1] != x and w[0] != w[1] for x, w in want.items())
    assert told(S13.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block_words=block_words)) == want


def test_variants_of_awkward_tables(spark):
    docs = awkward(spark).selectExpr("*", "'x' as word", "'x' as block", "map('a', 1) as tags")
    assert S13.spelling_variants(docs.limit(0)).count() == 0
    assert told(S13.spelling_variants(docs, least_length=3, least_count=2))["one"][2] == 3


def test_root_of_a_chain(spark):
    rows = [(f"w{i}", f"w{i + 1}") for i in range(21)] + [("v", "w9")]
    got = S13.roots(spark.createDataFrame(rows, "word string, form string")).collect()
    assert {tuple(r) for r in got} == {(w, "w21") for w, _ in rows}


FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def aligned(rows):
    """The result of the alignment, token by token, with the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    first, second = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    first.encode_special_tokens = True
    codes, docs = TA.byte_letters(), []
    assert sorted(codes.values()) == list(range(256)) and all(ByteLevel().decode([c]) == chr(b) for c, b in codes.items() if b < 128)
    for key, text in rows:
        a = first.encode(" " + text, add_special_tokens=False) if text else None
        ids = [a.ids if text else [], second.encode(text) if text else []]
        parts = [[bytes(codes[c] for c in t) for t in (a.tokens if text else [])], [bytes([int(p[3:-1], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(second.id_to_piece, ids[1])]]
        if not text or any(b"".join(p) != b" " + text.encode() for p in parts):
            docs.append((key, [], [], [], ""))
            continue
        spans = [[(sum(map(len, p[:i])), sum(map(len, p[: i + 1]))) for i in range(len(p))] for p in parts]
        links = [(x, y) for x, (s, e) in zip(ids[0], spans[0], strict=True) for y, (u, v) in zip(ids[1], spans[1], strict=True) if s < v and u < e]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        inside = lambda side, lo, hi: ",".join(str(i) for i, (_, e) in zip(ids[side], spans[side], strict=True) if lo < e <= hi)  # noqa: B023, E731
        docs.append((key, *ids, links, ";".join(f"{inside(0, lo, hi)}|{inside(1, lo, hi)}" for lo, hi in zip([0, *cuts], cuts, strict=False))))
    counts = collections.Counter(pair for d in docs for pair in set(d[3]))
    most = collections.Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return sorted(((k, len(a), len(b), groups.count("|"), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), groups) for k, a, b, links, groups in docs), key=str)


@pytest.mark.parametrize("common", [1_000_000, 200, 0])
def test_alignment_equals_brute_force(spark, common):
    rows = [(r[0], r[1]) for r in table(spark, SF, "documents").select("doc_id", "text").collect() if len(r[1] or "") < 1_500]
    rows += [(None, "Grüße, e\u0301t\u00e9\n\tno"), (1, None), (2, ""), (3, "a \u2581 b"), (4, "<s> </s> <|endoftext|> <0x41>"), (5, "  two  spaces "), (5, "  two  spaces "), (6, "\x00\U0001f600日本"), (7, " "), (8, "\u2581")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = TA.token_alignment(docs, *FILES, common=common)
    found = sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")) for r in got.collect()), key=str)
    assert found == aligned(rows)


def test_alignment_query_and_awkward_tables(spark):
    docs = awkward(spark).selectExpr("*", "'x' as row", "'x' as pairs", "'x' as n_best", "map('a', 1) as tags")
    got = {r["doc_id"]: r for r in TA.token_alignment(docs, *FILES).collect()}
    assert TA.token_alignment(docs.limit(0), *FILES).count() == 0
    assert all(tuple(got[k])[1:] == (0, 0, 0, 0, 0, 0, "") for k in (1, 2, 8)) and got[4]["n_a"] == 60_001 and got[4]["n_links"] == got[4]["n_a"] + got[4]["n_b"] - got[4]["n_groups"]
    from lociform.llm import queries

    digests = {r["doc_id"]: r["groups_sha256"] for r in queries.op12_token_alignment(spark, SF).collect()}
    whole = {r["doc_id"]: r["groups"] for r in TA.token_alignment(table(spark, SF, "documents"), *FILES).collect()}
    assert digests == {k: hashlib.sha256(g.encode()).hexdigest() if g else "" for k, g in whole.items()}


def shuffled(spark, work):
    """Bytes that work writes to shuffles."""
    so_far = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = so_far()
    work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return so_far() - before


def unlike(rng, n, words=400):
    return [" ".join(f"w{x}" for x in rng.integers(0, 50_000, words)) for _ in range(n)]


def test_branches_are_shuffled_packed(spark):
    """Documents without partners: nine bytes for each of their 150 branches, and what rows and digests take."""
    rng = np.random.default_rng(11)
    docs = spark.createDataFrame(list(enumerate(unlike(rng, 1_500))), "doc_id long, text string").repartition(3).localCheckpoint()
    written = shuffled(spark, lambda: J.jaccard_join(docs).write.format("noop").mode("overwrite").save())
    assert written < 2_000 * 1_500


def test_a_shared_passage_makes_no_candidates(spark, monkeypatch):
    """Texts share a fifth of their words in one passage: some branches, but fewer than partners have in common."""
    rng = np.random.default_rng(12)
    passage, near = unlike(rng, 1, 80)[0], unlike(rng, 1)[0]
    texts = [f"{passage} {x}" for x in unlike(rng, 600, 320)] + [near, f"{near} end", f"start {near}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen, verified = [], J._verified
    monkeypatch.setattr(J, "_verified", lambda d, mark, body, classes, *rest: seen.append(classes.select("digest").distinct().count()) or verified(d, mark, body, classes, *rest))
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_join(docs).collect()}
    assert got == {k: min(k, 600) for k in range(603)}
    assert seen[0] < 60


def test_common_branches_and_equal_sets_of_many_tasks(spark):
    """Groups larger than what a task sends on, with equal sets in every partition."""
    rng = np.random.default_rng(13)
    texts = [t for _, t in near_copies(rng, groups=3, copies=30)] * 4
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    sets = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} for i, w in enumerate(t.split() for t in texts[:90])}
    linked = np.array([[100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) for b in sets] for a in sets])
    label = components(linked)
    assert 1 < len(set(label.tolist())) < 80
    assert {r["doc_id"]: r["component_id"] for r in J.jaccard_join(docs).collect()} == {i: label[i % 90] for i in range(360)}


def test_representatives_that_stay_are_not_shuffled(spark):
    """One text in ten is a copy or a repeated row; the others stay where they are."""
    rng = np.random.default_rng(14)
    texts = unlike(rng, 1_000)
    rows = [(i, t) for i, t in enumerate(texts)] + [(2_000 + i, texts[i]) for i in range(60)] + [(i, texts[i]) for i in range(60, 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).localCheckpoint()
    alone = shuffled(spark, lambda: J.jaccard_join(docs).write.format("noop").mode("overwrite").save())
    kept = []
    written = shuffled(spark, lambda: kept.extend(J.representatives(docs).collect()))
    assert sorted((r["doc_id"], r["text"]) for r in kept) == list(enumerate(texts))
    assert written - alone < sum(map(len, texts)) / 3
