"""What a Python worker holds beside its executor's heap, which outlives the task."""

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from canopy.llm import bpe
from canopy.llm.common import text_runs


def test_an_encoder_remembers_few_words():
    path = bpe.default_vocabulary()
    own = bpe.WordBpe(path)
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(200_000)]
    texts = [" ".join(names[i : i + 2000]) for i in range(0, len(names), 2000)]
    got = list(own.encode(texts))
    assert len(own._known) + len(getattr(own, "_older", {})) < 140_000
    library = Tokenizer.from_file(path)
    for k in (0, 50, 99):
        assert got[k][1].split(" ") == [str(i) for i in library.encode(texts[k], add_special_tokens=False).ids]
    assert list(own.encode(texts[:3])) == got[:3]  # of what was forgotten, and of both halves


def test_rows_are_encoded_in_short_runs(spark):
    texts = ["word " * 20_000, None, "", *["a few words"] * 30_000]
    runs = list(text_runs(pa.array(texts, pa.string()), bpe.BLOCK_CHARS))
    assert [n for _, n in runs][0] >= 3 and sum(n for _, n in runs) == len(texts)
    assert all(sum(len(t or "") for t in texts[low : low + n]) <= bpe.BLOCK_CHARS for low, n in runs)
    rows = bpe.encode(spark.createDataFrame([(1, None), (2, ""), (3, "a few words"), (4, "word " * 100_000)], "id int, text string"), bpe.default_vocabulary()).orderBy("id").collect()
    assert [(r.n_tokens, len(r.token_ids)) for r in rows] == [(0, 0), (0, 0), (3, 3), (100_000, 100_000)]
