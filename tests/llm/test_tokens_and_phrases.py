"""Alignment, byte-level BPE and collocations against brute force, with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import collections
import glob
import hashlib
import itertools
import random
import re

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from boresight.llm import alignment, bytebpe, collocations, common, queries

A_PATH, B_PATH, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"))
SCHEMA = "doc_id long, text string, lang string, ids int, stretches string, `n links` int, links string, `range` int, phrase string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    pool = ["the", "soil", "river's", "Zürich", "größer", "naïve", "naive", "中文字", "🙂🙃", "don't", "x_y", "3.14", "2024", "<|endoftext|>", "</s>", "ſt", "ﬁne", "\x1c", " ", "՘", "\U000107bb", "é"]
    texts = ["".join(r.choice(pool) + r.choice([" ", " ", " ", "  ", "\n", "\t", ". ", ", ", "\r\n", "", "\xa0"]) for _ in range(r.randint(1, 40))) for _ in range(60)]
    texts += [None, "", " ", "  lead", "trail  ", "a▁b c", "\x00", "one", "One", "\n\n  two", "x" * 60_000, "ab" * 20_000 + " end", "word and " * 30_000, texts[0], texts[0], texts[1]]
    return [(k if k != 5 else None, t, r.choice(["en", "de", None, "und"]), 1, "s", 2, "l", 3, "p") for k, t in enumerate(texts)] + [(3, texts[3], "en", 1, "s", 2, "l", 3, "p")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_byte_bpe_is_the_librarys(docs, rows):
    import tiktoken

    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})
    back = bytebpe.decode(bytebpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).select("doc_id", "text", "ids", "decoded").collect()
    assert len(back) == len(rows)
    for row in back:
        text = row["text"] or ""
        assert bytes(row["decoded"]).decode() == text
        if len(text) < 50_000:  # the library's own merging is square in a match
            assert row["ids"] == theirs.encode_ordinary(text), text[:80]


def test_byte_bpe_on_random_letters_and_all_characters():
    import tiktoken

    known, cut, r = bytebpe.matches(RANKS), bytebpe.cutter(public_tokenizers.PATTERN), random.Random(1)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})
    every = [*range(0xD800), *range(0xE000, 0x110000)]
    for k in range(800):
        text = "".join(r.choice("aeiounrst") for _ in range(60)) if k % 2 else "".join(chr(r.choice(every)) for _ in range(30))
        assert bytebpe.encoded(known, cut, [text, " plain"])[0].tolist()[:-1] == theirs.encode_ordinary(text)


def test_byte_bpe_small_vocabularies():
    """Vocabularies of random merges, against merging pair by pair."""
    r = random.Random(3)
    for _ in range(40):
        ranks = {bytes([c]): k for k, c in enumerate(b"abc")}
        corpus = [bytes(r.choice(b"abc") for _ in range(30)) for _ in range(6)]
        while len(ranks) < 14:  # merge the most frequent pair, as a trainer does
            pairs = collections.Counter()
            for text in corpus:
                ids = bytebpe.merged(ranks, text)
                tokens = {v: t for t, v in ranks.items()}
                pairs.update(tokens[x] + tokens[y] for x, y in zip(ids, ids[1:]))
            ranks[max(pairs, key=lambda p: (pairs[p], p))] = len(ranks)
        vocabulary = bytebpe.Vocabulary(ranks)
        for _ in range(60):
            text = bytes(r.choice(b"abc") for _ in range(r.randint(1, 25)))
            assert list(vocabulary.encode(text)) == ([ranks[text]] if text in ranks else bytebpe.merged(ranks, text))
    with pytest.raises(ValueError):
        vocabulary.encode(b"z")


def test_decoding_refuses_other_ids(spark):
    df = spark.createDataFrame([(1, [72]), (2, [72, 60_000]), (3, None), (4, []), (5, [72, None]), (6, [-1])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bytebpe.decode(df, RANKS).collect()}
    assert {k for k, v in got.items() if v is None} == {2, 3, 5, 6} and got[4] == b""


def alignment_of(rows):
    """Brute force: tokens of whole texts, all pairs of a group."""
    a_side, b_side = alignment.ByteLevel(A_PATH), alignment.Pieces(B_PATH)
    out, counts = [], collections.Counter()
    for row in rows:
        text = row[1]
        a = a_side.own.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.own.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(a_side.bytes[i] for i in a) != whole or b"".join(b_side.bytes[i] for i in b) != whole:
            a = b = []
        ends = [list(itertools.accumulate(len(side.bytes[i]) for i in ids)) for side, ids in ((a_side, a), (b_side, b))]
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            groups.append((a[i:i2], b[j:j2]))
            begin = lambda e, k: e[k - 1] if k else 0
            links += [(a[x], b[y]) for x in range(i, i2) for y in range(j, j2) if max(begin(ends[0], x), begin(ends[1], y)) < min(ends[0][x], ends[1][y])]
            i, j = i2, j2
        counts.update(links)
        out.append((row[0], a, b, groups, links))
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(k, len(a), len(b), len(g), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)) for k, a, b, g, links in out]


@pytest.mark.parametrize("most", [alignment.PAIRS_SENT, 40])
def test_alignment_against_brute_force(docs, rows, most):
    blocks = alignment.tokenise(docs, A_PATH, B_PATH)
    digested = alignment.digested(blocks, lambda whole: whole, "written")
    got = alignment.with_links(digested, most)
    assert {"lang", "n links", "links", "range"} <= set(got.columns)
    got = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.coalesce("written", F.lit(""))).collect()
    want = alignment_of(rows)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(r[1] == 0 for r in want) >= 3 and max(r[1] for r in want) > 20_000


def test_blocks_hold_each_pair_once(docs, rows):
    """A link costs its place among the block's pairs; tokenising and digesting in one go gives the same."""
    few = docs.where("doc_id < 40")
    blocks = alignment.digested(alignment.tokenise(few, A_PATH, B_PATH, keep=["doc_id"]), lambda whole: whole, "written").collect()
    counts = collections.Counter()
    for block in blocks:
        assert len(set(block["pairs"])) == len(block["pairs"]) == max(block["link_at"]) + 1 and len(block["link_at"]) == block["link_ends"][-1]
        counts.update(dict(zip(block["pairs"], block["pair_uses"])))
    wanted = collections.Counter(p for r in alignment_of([r for r in rows if r[0] is not None and r[0] < 40]) for p in [r[4]])
    assert sum(counts.values()) == sum(n * m for n, m in wanted.items())
    at_once = alignment.tokenise_digested(few, A_PATH, B_PATH, lambda whole: whole, "written", keep=["doc_id"]).collect()
    assert sorted(at_once) == sorted(blocks)


def test_long_stretches_are_forgotten(monkeypatch):
    """Tokens of long stretches, which are not looked up again, don't pile up in a worker."""
    monkeypatch.setattr(alignment, "CACHE_STRETCHES", 50)
    tables = alignment.Known(A_PATH, B_PATH)
    for k in range(0, 200, 10):
        tables.tokenised([f" {'ab' * 50}{i}" for i in range(k, k + 10)])
        assert len(tables.same) <= 50 and all(len(side.sizes) <= 50 for side in tables.sides)
    monkeypatch.setattr(alignment, "CACHE_TOKENS", 100)
    for k in range(20):
        tables.tokenised([f" {'ab' * 500}{k}"])
        assert all(len(side.ids) <= 100 + 1100 for side in tables.sides)


def test_stored_blocks_are_read_one_by_one(docs, monkeypatch):
    """A reader gets no more than one block at a time: each has a row group of its own, in whatever number a task has written them."""
    paths, stored = {}, common.stored

    def watched(df, tag, **options):
        out = stored(df, tag, **options)
        paths[tag] = out._boresight_path.removeprefix("file://")
        return out

    monkeypatch.setattr(common, "stored", watched)
    blocks = alignment.tokenise_digested(docs.where("doc_id < 40").repartition(8), A_PATH, B_PATH, lambda whole: whole, "written", keep=["doc_id"])
    assert alignment.with_links(blocks.coalesce(1)).count() == 40
    groups = [f.metadata.row_group(k).num_rows for f in map(pq.ParquetFile, glob.glob(f"{paths['aligned']}/*.parquet")) for k in range(f.num_row_groups)]
    assert groups == [1] * 8


def test_aligned_documents(docs, rows):
    got = alignment.aligned(alignment.tokenise(docs.where("length(text) < 5000 or text is null"), A_PATH, B_PATH, keep=["doc_id", "ids"])).collect()
    want = {r[0]: r for r in alignment_of([r for r in rows if r[1] is None or len(r[1]) < 5000])}
    for row in got:
        assert ";".join(",".join(map(str, g["a"])) + "|" + ",".join(map(str, g["b"])) for g in row["groups"]) == want[row["doc_id"]][7]
        assert len(row["links"]) == want[row["doc_id"]][4]


def phrases_of(rows, longest, least):
    counts, total = collections.Counter(), collections.Counter()
    for row in rows:
        lang = "und" if row[2] is None else row[2]
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), row[1] or "")):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            counts.update((lang, tuple(words[i : i + m])) for i in range(len(words)) for m in range(1, longest + 1) if i + m <= len(words))
    return {k: n for k, n in counts.items() if n >= least}, total


def scores_of(found, total, percent=100):
    out = []
    for (lang, p), a in found.items():
        if len(p) < 2:
            continue
        if any(l2 == lang and len(q) > len(p) and 100 * n >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (l2, q), n in found.items()):
            continue
        cuts = [(1000 * a * total[lang] // (found[lang, p[:k]] * found[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, found[lang, p[:k]], found[lang, p[k:]], total[lang], score))
    return out


@pytest.fixture(scope="module")
def speech(spark):
    r = random.Random(5)
    made = ["in the end", "on the other hand", "as well as that", "A B A B a b"]
    rows = [(k, "".join((r.choice(made) if r.random() < 0.4 else r.choice("abcdefgh")) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None, "und"]), 1, "s", 2, "l", 3, "p") for k in range(150)]
    rows += [(900, None, None, 1, "s", 2, "l", 3, "p"), (901, "", "fr", 1, "s", 2, "l", 3, "p"), (902, "x y z " * 20_000, "long", 1, "s", 2, "l", 3, "p"), rows[0], rows[0]]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


@pytest.mark.parametrize(("fan_in", "range_bits"), [(256, 8), (2, 2)])
def test_phrases_against_counting(spark, speech, monkeypatch, fan_in, range_bits):
    rows, docs = speech
    found = collocations.phrases(docs, 5, 6, fan_in=fan_in, range_bits=range_bits)
    want, total = phrases_of(rows, 5, 6)
    got = found.collect()
    assert {(r["lang"], tuple(r["phrase"].split(" "))): r["a"] for r in got if r["size"]} == want and len(got) == len(want) + len([n for n in total.values() if n])
    assert {r["lang"]: r["a"] for r in got if not r["size"]} == {k: n for k, n in total.items() if n}
    for percent in (100, 70):
        scored = collocations.scored(found, percent)
        assert sorted(map(tuple, scored.select("lang", "phrase", "a", "l", "r", "n", "score").collect())) == sorted(scores_of(want, total, percent))
    first = collocations.best(scored, 3).collect()
    for lang in {r["lang"] for r in first}:
        own = sorted((r for r in scores_of(want, total, 70) if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:3]
        assert [(r["rank"], r["phrase"]) for r in sorted(first, key=lambda r: r["rank"]) if r["lang"] == lang] == [(k + 1, r[1]) for k, r in enumerate(own)]


def test_shards_flush(speech):
    """A task that makes several tries gives the same counts."""
    import pyarrow as pa

    rows, _ = speech
    rows = [r for r in rows if r[2] != "long"]
    tries = []
    every = collocations.Map(1, {0: b"\xff" * (1 << collocations.PART_BITS - 3)})
    for k in range(0, len(rows), 40):
        shard, batch = collocations.Shard(5), pa.RecordBatch.from_pydict({"text": pa.array([r[1] for r in rows[k : k + 40]], pa.string()), "lang": pa.array([r[2] for r in rows[k : k + 40]], pa.string())})
        for vocabulary, word, left, names, lang in collocations.read(batch):
            one, two = collocations.hashes(vocabulary, word, names, lang, left)
            shard.add(vocabulary, word, left, names, lang, every.has(one), every.has(two) & (left > 1))
        tries.append([collocations.Trie.read(blob) for _, blob in shard.trie().ranges(3)])
    want, _ = phrases_of(rows, 5, 1)
    got = collocations.merged([t for part in tries for t in part]).rows(1).to_pylist()
    assert {(r["lang"], tuple(r["phrase"].split(" "))): r["a"] for r in got if r["size"]} == want


def test_scores_beyond_64_bits(spark):
    big = 900_000_000_000_000
    found = spark.createDataFrame([("en", 0, "", 9 * big), ("en", 1, "a", big - 1), ("en", 1, "b", big - 3), ("en", 2, "a b", big - 7)], "lang string, size int, phrase string, a long")
    row = collocations.scored(found).first()
    assert row["score"] == 1000 * (big - 7) * 9 * big // ((big - 1) * (big - 3))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert collocations.best(collocations.scored(collocations.phrases(empty))).count() == 0
    assert bytebpe.decode(bytebpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
    assert alignment.aligned(alignment.tokenise(empty, A_PATH, B_PATH)).count() == 0


def test_queries_on_a_table(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_alignment(spark, str(tmp_path)).collect()
    want = {(r[0], *r[1:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in alignment_of(rows)}
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    empty = hashlib.sha256(b"").hexdigest()
    got = queries.op13_byte_bpe(spark, str(tmp_path)).collect()
    assert sum(r["ids_sha256"] == empty for r in got) == 2 and {r["decoded_sha256"] for r in got} == {hashlib.sha256((t[1] or "").encode()).hexdigest() for t in rows}
    assert common.BLOCK_BYTES < alignment.BLOCK_BYTES * 2
