"""What Python workers hold: nothing of another stage's memo, and no arrays that grow with the texts of a batch."""

import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import langid, neardup, shingles, vocab


class Captured:
    """Stands for a DataFrame and keeps the function of its tasks."""

    def __getattr__(self, name):
        return lambda *args, **how: self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


TASKS = {
    "language": lambda: langid.language_id(Captured(), langid.ByteGru(["en", "fr"])),
    "signatures": lambda: neardup.signatures(Captured()),
    "nodes": lambda: neardup.compare_nodes(Captured()),
    "confirm": lambda: neardup.confirm(Captured(), Captured()),
}


@pytest.mark.parametrize("task", TASKS)
def test_memo_of_an_earlier_stage_is_dropped(spark, task):
    path = vocab.default_path("word_bpe_49k.json")
    before = vocab.encoder(path)
    ids = before.packed("the memo of an earlier stage")
    assert len(before.memo)
    list(TASKS[task]().run(iter([])))
    assert not vocab._ENCODERS and not before.memo and not before.memo.last
    assert vocab.encoder(path) is not before and vocab.encoder(path).packed("the memo of an earlier stage") == ids == before.packed("the memo of an earlier stage")


def test_long_texts_are_hashed_part_by_part(spark, monkeypatch):
    """Sets of a batch of long texts are the same as one by one, and no call gets more than a part's characters."""
    rng, sizes = np.random.default_rng(5), []
    texts = [" ".join(rng.choice(list("abcdefgh"), 9)) + " é" + f" w{k}x" * 20_000 for k in range(12)] + ["", "one two"]
    whole = shingles.shingle_sets
    monkeypatch.setattr(shingles, "shingle_sets", lambda given, *more: sizes.append(sum(len(t.decode()) + 1 for t in given)) or whole(given, *more))
    pairs = [(a, b) for a in range(12) for b in range(a, 12)]
    batch = pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs]), pa.array([b + 100 for _, b in pairs]), pa.array([texts[a] for a, _ in pairs]), pa.array([texts[b] for _, b in pairs])], ["a", "b", "text_a", "text_b"])
    out = [r for part in neardup.confirm(Captured(), Captured()).run(iter([batch])) for r in part.to_pylist()]
    assert [(r["a"], r["b"] - 100) for r in out] == [(a, b) for a, b in pairs if shingles.linked(whole([texts[a].encode()])[0], whole([texts[b].encode()])[0])]
    assert max(sizes) <= 300_000
    assert all((x == whole([t.encode()])[0]).all() for x, t in zip(neardup.sets_of(texts), texts, strict=True))
