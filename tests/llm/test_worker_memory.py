"""What operators leave in a Python worker goes when another operator's tasks begin there."""

import gc
import weakref

import pyarrow as pa
import pytest


def test_encoders_go_when_let_go():
    pytest.importorskip("ahocorasick")
    from aerocast.llm import bpe
    from aerocast.llm.common import large_binaries, let_go
    from aerocast.llm.units import CUT_PATTERN
    data = b"\n".join(__import__("base64").b64encode(bytes([i])) + b" %d" % i for i in range(256))
    coder = bpe.loaded(data, CUT_PATTERN)
    assert [len(ids) for _, _, ids, _ in coder.coder.slices(large_binaries(pa.array(["one two", None])))] == [7]
    gone = weakref.ref(coder)
    del coder
    gc.collect()
    assert gone() is not None  # kept for the next task of the same operator
    let_go()
    assert gone() is None
    let_go()
    assert bpe.loaded(data, CUT_PATTERN).ranks[b"a"] == 97


@pytest.mark.parametrize("step", ["features", "shingles"])
def test_a_large_batch_takes_little_memory_at_a_time(step):
    import random
    import tracemalloc

    from aerocast.llm.common import large_binaries
    from aerocast.llm.minhash import shingle_sets
    from aerocast.llm.quality import text_features
    rng = random.Random(3)
    words = [f"w{i:x}" for i in range(5000)]
    batch = large_binaries(pa.array([" ".join(rng.choices(words, k=400)) for _ in range(3000)]))
    tracemalloc.start()
    try:
        rows = 0
        for first, last, *_ in text_features(batch) if step == "features" else shingle_sets(batch, 5):
            rows += last - first
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 3000 and peak < 8 * len(batch.buffers()[2])


@pytest.mark.parametrize("step", ["features", "shingles"])
def test_a_task_gives_memory_back_when_it_ends(step):
    """A worker that waits held 149 MB after the features of a few batches, 187 after shingle sets; 70 given back."""
    import os
    import subprocess
    import sys
    if not os.path.exists("/proc/self/smaps_rollup"):
        pytest.skip("memory can't be read here")
    code = """if True:
        import random, re
        import pyarrow as pa
        from aerocast.llm import common
        from aerocast.llm.minhash import shingle_sets
        from aerocast.llm.quality import text_features
        spare = common.spare
        held = lambda: int(re.search(r"Pss_Anon: +(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
        rng = random.Random(3)
        words = [f"w{i:x}" for i in range(5000)]
        text = lambda: " ".join(rng.choices(words, k=400))
        STEP = {"features": text_features, "shingles": lambda t: shingle_sets(t, 5)}["%s"]
        def run(batches):
            for b in batches:
                for first, last, *_ in STEP(common.large_binaries(b.column(0))):
                    yield last - first
        before = held()
        for _ in range(3):
            assert sum(spare(run)(pa.record_batch([pa.array([text() for _ in range(2000)])], names=["text"]) for _ in range(3))) == 6000
        print(held() - before)
    """ % step
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    left = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root, "OMP_NUM_THREADS": "1"}, capture_output=True, text=True, check=True).stdout
    assert int(left) < 45
