"""A Python worker keeps no chunks of a task that is over, whether it was read to its end or not."""

import pyarrow as pa
import pytest

from tickloom.llm import packing
from tickloom.llm.queries import tokenizer_path


def batches():
    for i in range(3):
        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([f"the house {i} by the sea, and word{i}"])], names=["doc_id", "text"])


@pytest.mark.parametrize("read", [1, 3])
def test_cache_is_empty_after_a_task(read):
    encode = packing.encoder(tokenizer_path())
    task = packing._cut_pieces(batches(), tokenizer_path(), 4096, 1)
    first = [next(task) for _ in range(read)]
    assert encode.new  # during the task it is used
    if read == 3:
        assert next(task, None) is None
    task.close()
    assert not encode.new and not encode.old
    assert packing.encoder(tokenizer_path()) is encode  # the tokenizer is not read anew
    again = list(packing._cut_pieces(batches(), tokenizer_path(), 4096, 1))
    assert again[:read] == first
