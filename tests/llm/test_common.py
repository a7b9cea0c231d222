import pyarrow as pa

from tidemark.llm import common as C
from tidemark.llm import langid


def test_parts_of_a_batch_give_the_words_of_the_whole():
    """Parts that do not begin at the batch's first row are read right."""
    texts = [None if i % 37 == 0 else f"  Alpha{i} b\u00e9ta\tGAMMA{i % 5} \n" * (1 + i % 9) for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    got, langs = [], []
    model = langid.fit([("alpha beta gamma", "en"), ("Stra\u00dfe und so", "de")] * 20, epochs=1)
    for part in C.small_batches([batch], 20_000):
        offsets, words, idx = C.words_of_batch(part.column(1))
        names = words.to_pylist()
        got += [[names[k] for k in idx[offsets[j]:offsets[j + 1]]] for j in range(part.num_rows)]
        langs += list(langid._score(model, part.column(1))[1])
    plain = [(t or "").encode().lower().decode().split() for t in texts]
    assert got == plain
    assert langs == [langid._score(model, pa.array([t], pa.string()))[1][0] for t in texts]
