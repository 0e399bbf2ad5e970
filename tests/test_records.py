"""Records and rejects of files in byte ranges, against one scan of the whole file."""

import json
import random

import pytest
from pyspark.sql import types as T

from spoolworks.sources import records as R

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])
HARD = ['plain', 'quote " and \\ slash', '},{"id":7,"text":"inner"},', "[{\"id\": 1}]", "tail\\", "\n{\n", "日本 é 🙂", "", "a" * 3000, "{", "}]", "\\\"", '},{']


def record(i):
    return {"id": i, "text": HARD[i % len(HARD)] + str(i), "tags": [HARD[(i + 3) % len(HARD)]]}


class Whole:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def one_scan(data, lines):
    return [f for f in R.RecordScanner(Whole(data), len(data), lines, SCHEMA.names).scan(0, len(data)) if f[0] != "exit"]


def put(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)


@pytest.mark.parametrize("indent,range_bytes", [(None, 97), (2, 5000)])
def test_array_over_many_ranges(spark, tmp_path, indent, range_bytes):
    want = [record(i) for i in range(300)]
    put(tmp_path / "a", "one.json", json.dumps(want, indent=indent, ensure_ascii=indent is None).encode())
    got = R.scan_array_ranges(spark, str(tmp_path / "a"), SCHEMA, range_bytes).collect()
    assert sorted((r.id, r.text, list(r.tags)) for r in got) == [(r["id"], r["text"], r["tags"]) for r in want]


def broken(i, text):
    """A record's text, hurt in one of many ways, or whole."""
    return {
        3: text[: len(text) // 2], 5: text.replace('"', "", 1), 9: text.replace(":", "", 1), 11: text[:-1], 13: "17", 15: '"only text"', 17: "oops",
    }.get(i % 20, text)


@pytest.mark.parametrize("range_bytes", [64, 1 << 20])
def test_rejects_do_not_depend_on_ranges(spark, tmp_path, range_bytes):
    texts = [broken(i, json.dumps(record(i), ensure_ascii=False)) for i in range(240)]
    files = {
        "array.json": ("[" + ", ".join(texts) + "]").encode(),
        "broken_array.json": ("[\n" + ",\n".join(texts)).encode() + b'\n{"id": 1, "text": "bad \xff byte"}',
        "lines.jsonl": ("\n".join(t.replace("\n", " ") for t in texts) + "\n").encode(),
        "object.json": json.dumps(record(5), indent=1).encode(),
        "empty.json": b"",
        "blank.json": b" \n ",
        "none.json": b"[]",
    }
    for name, data in files.items():
        put(tmp_path / "b", name, data)
    got = R.scan_record_bytes(spark, str(tmp_path / "b"), SCHEMA.names, range_bytes=range_bytes).collect()
    for name, data in files.items():
        mine = sorted((r.offset, r.length, bytes(r.record), r.reason) for r in got if r.file.endswith("/" + name))
        assert mine == [f[1:] for f in one_scan(data, name == "lines.jsonl")], name
        for offset, length, body, _ in mine:
            assert data[offset : offset + length] == body


def test_what_is_broken_is_known(spark, tmp_path):
    texts = [broken(i, json.dumps(record(i))) for i in range(100)]
    put(tmp_path / "c", "x.json", ("[" + ",\n".join(texts) + "]").encode())
    good, rejects = R.scan_records(spark, str(tmp_path / "c"), SCHEMA, range_bytes=500)
    hurt = {i for i in range(100) if i % 20 in (3, 5, 9, 11, 13, 15, 17)}
    assert sorted(r.id for r in good.collect()) == [i for i in range(100) if i not in hurt]
    assert rejects.count() == len(hurt)


def test_misfits_and_long_records(spark, tmp_path):
    data = b'[{"id": "no number", "text": "x"}, {"id": 1, "text": "' + b"y" * 5000 + b'"}, {"id": 2, "text": "z"}]'
    put(tmp_path / "d", "x.json", data)
    good, rejects = R.scan_records(spark, str(tmp_path / "d"), SCHEMA, limit=1000)
    assert [r.id for r in good.collect()] == [2]
    assert sorted(r.reason for r in rejects.collect()) == ["does not fit the schema", "longer than 1000 bytes"]
    with pytest.raises(ValueError, match="does not fit"):
        R.scan_array_ranges(spark, str(tmp_path / "d"), SCHEMA)


def test_random_damage(spark, tmp_path):
    """Bytes changed at random: the ranges together still say what one scan says."""
    rng = random.Random(1)
    for k in range(2):
        data = bytearray(json.dumps([record(i) for i in range(60)]).encode())
        for _ in range(12):
            data[rng.randrange(len(data))] = rng.choice(b'"{}[],:\\x\n')
        put(tmp_path / f"r{k}", "x.json", bytes(data))
        got = R.scan_record_bytes(spark, str(tmp_path / f"r{k}"), SCHEMA.names, layout="document", range_bytes=150).collect()
        assert sorted((r.offset, r.length, bytes(r.record), r.reason) for r in got) == [f[1:] for f in one_scan(bytes(data), False)]
