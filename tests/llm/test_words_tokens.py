import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from wordloom.llm import codec, fuse, tokens
from wordloom.llm.tokens import Encoder, default_path
from wordloom.llm.words import hashed_words, shingle_sets, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_shingles(text):
    words = WORD.findall(lower(text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


TEXTS = [None, "", "  \t\n", "one", "One ONE one", "a b c d", "a b c d e", "a b c d e a b c d e a b c d e", "É é x\x0by", "x" * 5000 + " y"]


def test_words_do_not_cross_texts():
    hashes, counts, _ = hashed_words(pa.array(["ab", "cd", "", "abcd ab"]))
    assert counts.tolist() == [1, 1, 0, 2]
    assert hashes[0] == hashes[3] and len(set(hashes.tolist())) == 3


def test_shingle_sets_like_plain_sets():
    random.seed(1)
    texts = TEXTS + [" ".join(random.choice("abc") for _ in range(n)) for n in range(40)]
    sets = shingle_sets(pa.array(texts))
    plain = [plain_shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 100, "", "c"]})
    parts = list(slices(batch, "text", 12))
    assert sum((p.column("text").to_pylist() for p in parts), []) == batch.column("text").to_pylist()
    assert len(parts) > 1


def test_encoder_gives_the_tokenizers_ids():
    random.seed(2)
    pieces = ["a", " ", "  ", "\n", "don't", "é", "ß", " ", " ", "日本", "123", "!?", "<|endoftext|>", "\x85", "\x1f", "word"]
    texts = TEXTS + ["".join(random.choice(pieces) + random.choice(["", " ", " "]) for _ in range(60)) for _ in range(200)]
    encoder = Encoder(default_path())
    for _ in range(2):  # the second time from the cache
        ids, counts = encoder.encode(pa.array(texts))
        ends = np.cumsum(counts)
        for text, end, n in zip(texts, ends, counts, strict=True):
            assert ids[end - n : end].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_gives_the_tokenizers_ids_at_blank_lines():
    random.seed(3)
    texts = ["a\n\nb", "a\n\n\n\nb", "end.\n\nThe next", "a\n\n", "b\n", "\nc", "\n\nc", "a\r\n\r\nb", "a \n\t\nb", "\xa0\nb", "a\n \n b", "\n\n", "x", "<|endoftext|>\n\n", "y"]
    pieces = ["a", "1", "The", " ", "\n", "\n\n", "\n", "\t", "\r\n", "\x0b", ".", "'s", "é", "×", "\xa0", "\u2003", "日", "\x85"]
    texts += ["".join(random.choices(pieces, k=random.randrange(12))) for _ in range(20_000)]
    encoder = Encoder(default_path())
    ids, counts = encoder.encode(pa.array(texts))
    ends = np.cumsum(counts)
    for text, end, n in zip(texts, ends, counts, strict=True):
        assert ids[end - n : end].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("n", [1, 2, 100, 8192, 8193, 40_000])
def test_codec_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.5, rng.integers(0, 20, n), rng.integers(0, 1 << 17, n)).astype(np.uint32)
    table, blocks = codec.encode(ids)
    counts = [min(codec.BLOCK_IDS, n - i) for i in range(0, n, codec.BLOCK_IDS)]
    assert (np.concatenate(codec.decode(table, blocks, counts)) == ids).all()


@pytest.mark.parametrize("ids", [[0], [2**32 - 1, 5, 5, 5], [7] * 9000, list(range(4097)), [2**31, 0] * 3000])
def test_codec_of_any_ids(ids):
    ids = np.array(ids, np.uint32)
    table, blocks = codec.encode(ids)
    counts = [min(codec.BLOCK_IDS, len(ids) - i) for i in range(0, len(ids), codec.BLOCK_IDS)]
    assert (np.concatenate(codec.decode(table, blocks, counts)) == ids).all()
    # A block is decoded without the others.
    assert (codec.decode(table, blocks[-1:], counts[-1:])[0] == ids[len(ids) - counts[-1] :]).all()


def test_codec_learns():
    ids = np.tile(np.arange(50, dtype=np.uint32) * 900, 400)
    table, blocks = codec.encode(ids)
    assert len(table) + sum(map(len, blocks)) < len(ids) / 4  # under 2 bits an id: each follows from the last


def test_codec_beats_static_order_0_and_zlib(sf_dir):
    """Whole files of real texts, table and block heads counted."""
    texts = pq.read_table(f"{sf_dir}/documents.parquet").sort_by("doc_id").column("text").combine_chunks()
    ids, _ = Encoder(default_path()).encode(texts)
    table, blocks = codec.encode(ids)
    size = len(table) + sum(map(len, blocks)) + 12 * len(blocks)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert size < 0.95 * len(ids) * -(share * np.log2(share)).sum() / 8
    assert size < 0.9 * len(zlib.compress(ids.astype("<u2").tobytes()))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 100, 5000, 100_000])
def test_fuse_filter_has_all_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    filter_ = fuse.build(np.concatenate((keys, keys[: n // 2])))
    assert fuse.contains(filter_, keys).all()
    others = rng.integers(1 << 63, (1 << 64) - 1, 100_000, dtype=np.uint64)
    assert fuse.contains(filter_, others).mean() < 1e-3
    if n >= 5000:
        assert len(filter_[3]) < 3.2 * n


def test_a_chunk_is_looked_up_once(monkeypatch):
    """Known and new chunks of a slice in one pass, also where the new ones are learnt in several calls."""
    class Counted(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

        def __contains__(self, key):
            self.asked += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    monkeypatch.setattr(tokens, "LEARNT_CHUNKS", 3)
    encoder = Encoder(default_path())
    encoder.known = Counted()
    for texts in (["one two three two", "", None, "four five six one"], ["six seven one eight nine", "ten two"]):
        distinct = {c for t in texts if t for c in re.findall(r" ?\S+", t)}
        before = encoder.known.asked
        ids, counts = encoder.encode(pa.array(texts, pa.string()))
        assert encoder.known.asked - before == len(distinct)
        plain = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(plain, []) and counts.tolist() == [len(p) for p in plain]
