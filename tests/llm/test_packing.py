from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import no_docs, odd_docs
from tideweave.llm import packing


def brute_bfd(sizes: list[int], cap: int) -> int:
    rooms: list[int] = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(cap - s)
    return len(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    cap = rng.choice([7, 16, 100])
    sizes = [rng.randint(1, cap) for _ in range(rng.randint(0, 200))]
    counts = {s: sizes.count(s) for s in set(sizes)}
    plan = packing.best_fit_plan(counts.items(), cap)
    used: dict[int, list[tuple[int, int]]] = {}
    for s, n in counts.items():
        ranks = sorted(k for z, lo, hi, _, _ in plan if z == s for k in range(lo, hi))
        assert ranks == list(range(n))
    for z, lo, hi, first, offset in plan:
        for k in range(lo, hi):
            used.setdefault(first + k - lo, []).append((offset, z))
    for places in used.values():
        at = 0
        for offset, z in sorted(places):
            assert offset == at  # gapless
            at += z
        assert at <= cap
    assert len(used) == brute_bfd(sizes, cap)


def test_capacity_tree():
    rng = random.Random(1)
    tree, open_ = packing.CapacityTree(50), set()
    for _ in range(500):
        c = rng.randint(0, 50)
        tree.set(c, c not in open_)
        open_ ^= {c}
        q = rng.randint(0, 50)
        assert tree.find(q) == min((x for x in open_ if x >= q), default=-1)


def test_cut():
    for n in (1, 5, 1023, 1024, 1025, 2048, 5000):
        pieces = packing.cut(n, 1024)
        assert sum(z for _, z in pieces) == n and all(z == 1024 for _, z in pieces[1:]) and 1 <= pieces[0][1] <= 1024
        assert [s for s, _ in pieces] == list(np.cumsum([0] + [z for _, z in pieces])[:-1])


def test_fast_path_equals_the_json_tokenizer():
    bpe = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    letters = "".join(map(chr, range(256)))
    for i in range(300):
        text = "".join(rng.choice(letters if i % 2 else " '\n\tabst.re1é²\xa0\x85\x1c") for _ in range(rng.randint(0, 60)))
        assert bpe.encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids, repr(text)
    special = "a <|endoftext|> b"
    assert bpe.encode(special).tolist() == slow.encode(special, add_special_tokens=False).ids


def test_pack_odd_inputs(spark):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = odd_docs(spark)
    out = packing.pack(docs).toPandas()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array(slow.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        want += [(r.doc_id or -1, k, s, z, zlib.crc32(ids[s : s + z].tobytes())) for k, (s, z) in enumerate(packing.cut(len(ids), 1024))]
    got = [(int(r.doc_id) if r.doc_id == r.doc_id else -1, r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()]
    assert sorted(got) == sorted(want)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 1024
    assert out.sequence_id.nunique() == brute_bfd(out.length.tolist(), 1024)
    assert packing.pack(no_docs(spark)).count() == 0
