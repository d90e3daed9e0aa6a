"""What a worker holds: one thing at a time, until an operator that holds nothing begins."""

import pyarrow as pa

from tesserine.llm import words, workers


def test_a_worker_holds_one_thing_until_others_begin():
    made = []
    make = lambda: made.append(1) or dict(enumerate(range(1000)))
    first = workers.hold(("a",), make)
    assert workers.hold(("a",), make) is first and len(made) == 1
    workers.hold(("b",), make)
    assert list(workers._held) == [("b",)] and len(made) == 2
    list(words.blocks(pa.array(["some words"])))
    assert not workers._held
    workers.release()
    assert workers.hold(("a",), make) is not first
    workers.release()
