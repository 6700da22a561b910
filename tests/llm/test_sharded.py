import numpy as np

from sievelight.llm.sharded import Lookup


def test_lookup_finds_what_is_there():
    rng = np.random.default_rng(3)
    some = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    for keys in (some[:0], some[:1], some[:2000], np.array([0, 2**64 - 1, 2**63], np.uint64), np.arange(3000, dtype=np.uint64), some[:500].view(np.int64)):
        table = Lookup(keys, np.arange(len(keys)) + 1)
        asked = np.concatenate([keys, some.view(keys.dtype), np.array([0, 1, 2**64 - 1], np.uint64).view(keys.dtype)])
        at = {int(k): i + 1 for i, k in enumerate(keys.tolist())}
        hit, value = table.find(asked)
        assert value.tolist() == [at.get(k, 0) for k in asked.tolist()]
        assert hit.tolist() == [k in at for k in asked.tolist()]
