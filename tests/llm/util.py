"""Small tables with what real ones hold: nulls, empty and long texts, ties, repeated rows, other columns."""

import os

import pyarrow as pa
import pyarrow.parquet as pq

LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
ODD = [None, "", " \t\n", "one", "one", "a b c d e", "A B C D E", "a b c d e f g", "x\n\n\ny\n", "é中🙂 ́ ok", LONG, "!" * 3000, "9" * 5000, "a@" * 2000, "\n" * 500, "<p>&amp;", "+1 (111)", "the the " * 400]


def write(path, **tables):
    os.makedirs(path, exist_ok=True)
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), f"{path}/{name}.parquet")
    return str(path)


def odd_documents(path, texts=ODD, ids=None):
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    docs = {
        "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array([("en", None, "de")[i % 3] for i in range(n)], pa.string()),
        "source": pa.array([(None, "src1", "src2", "other")[i % 4] for i in range(n)], pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()),
        "key": pa.array(["clash"] * n), "hub": pa.array([1] * n), "__g": pa.array([2] * n), "token": pa.array([3] * n),
    }
    labels = {"doc_id": pa.array([0, 1, None, 99_999], pa.int64()), "quality": pa.array([0, None, 1, 0], pa.int32()), "toxic": pa.array([0, 0, None, 1], pa.int32())}
    pages = {"page_id": pa.array(ids, pa.int64()), "url": pa.array([None if i % 5 == 0 else f"http://h{i % 2}.example.com/{i}" for i in range(n)]), "html": pa.array(texts, pa.string())}
    return write(path, documents=docs, labels=labels, pages=pages)
