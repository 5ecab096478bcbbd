import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tabveil.llm import packing


def test_round_trip(spark, odd, none):
    r = np.random.default_rng(4)
    texts = [" ".join(f"w{k % 97}é" for k in range(n)) for n in r.integers(0, 900, 60)] + ["x <|endoftext|> y  \n\n z", "'s don't 12345  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.packed(df, keep_ids=True).collect()
    for d, text in enumerate(texts):
        want = [*plain.encode(text, add_special_tokens=False).ids, 0]
        own = sorted((x for x in rows if x.doc_id == d), key=lambda x: x.start)
        assert [i for x in own for i in x.ids] == want and all(x.doc_tokens == len(want) for x in own)
        assert all(x.ids_crc32 == zlib.crc32(np.array(want[x.start : x.start + x.length], "<u4").tobytes()) for x in own)
    by: dict[int, list] = {}
    for x in rows:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    total = padded = 0
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 1024
        total += at
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    assert padded <= 0.001 * total
    assert packing.packed(odd).where("start = 0").count() == 8 and packing.packed(none).count() == 0


def test_plan_covers_the_histogram():
    h = {300: 7, 724: 5, 512: 3, 900: 4, 1024: 2, 1: 9}
    patterns = packing.plan(h)
    used: dict[int, int] = {}
    for p, n in patterns:
        assert sum(k * c for k, c in p.items()) <= 1024
        for k, c in p.items():
            used[k] = used.get(k, 0) + c * n
    room = sum((1024 - sum(k * c for k, c in p.items())) * n for p, n in patterns)
    loose = sum(k * (h[k] - used.get(k, 0)) for k in h)
    assert all(used.get(k, 0) <= h[k] for k in h) and loose >= room
