"""Archives and documents of other writers, in small splits; RFECV over a restart."""

import json

import pytest

from mailspark.sources import mail as ML


@pytest.fixture
def tiny_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _plain_split(data: bytes) -> list[str]:
    """By lines: a line beginning with From opens a message, one empty line at a message's end goes."""
    out, open_ = [], False
    for line in data.split(b"\n"):
        if line.startswith(b"From "):
            out.append([])
            open_ = True
        elif open_:
            out[-1].append(line)
    msgs = []
    for i, lines in enumerate(out):
        if i == len(out) - 1:
            text = b"\n".join(lines)
        else:
            text = b"".join(x + b"\n" for x in lines)
        for end in (b"\r\n", b"\n"):
            if text == end or text.endswith(b"\n" + end):
                text = text[:-len(end)]
                break
        msgs.append(text.decode("latin-1"))
    return msgs


def _archive(n: int, eol: bytes, preamble: bytes = b"", blank: bool = True, final: bool = True) -> bytes:
    parts = [preamble]
    for i in range(n):
        parts.append(b"From u%d@x Thu" % i + eol + b"Subject: s%d" % i + eol + eol)
        parts.extend(b"body %d caf\xe9 \xc3\xa9 From here" % i + eol for _ in range(i % 4))
        if i % 5 == 0:
            parts.append(b">From quoted" + eol + eol)
        if blank:
            parts.append(eol)
    data = b"".join(parts)
    return data if final else data.rstrip(b"\r\n")


@pytest.mark.parametrize("split", [41, 100, 1 << 20])
def test_foreign_archives_in_small_splits(spark, tmp_path, tiny_splits, split):
    kinds = {"lf": _archive(60, b"\n"), "crlf": _archive(60, b"\r\n"), "pre": _archive(30, b"\n", b"preamble\n\nmore\n"),
             "dense": _archive(40, b"\n", blank=False), "cut": _archive(11, b"\n", final=False), "empty": b"",
             "none": b"no envelope\nat all\n", "only": b"From a@x Thu", "bare": b"From a\nFrom b\n\nFrom c\n", "lead": b"\nFrom a\nx\n\n\n\n"}
    for name, data in kinds.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    tiny_splits(split)
    got = {r.mail_id: r.raw for r in ML.read_mbox(spark, str(tmp_path / "*.txt")).collect()}
    want = {f"{name}_{i:05d}": text for name, data in kinds.items() for i, text in enumerate(_plain_split(data))}
    assert got == want


def test_quoted_lines_come_back(spark, tmp_path):
    raw = "Subject: x\n\nFrom here\n>From there\n>>From far\nnot >From\n"
    one = spark.createDataFrame([(raw,)], "raw string")
    ML.write_mbox(one.coalesce(1), str(tmp_path / "out"))
    assert [r.raw for r in ML.read_mbox(spark, str(tmp_path / "out"), unquote=True).collect()] == [raw]


def test_upgrade_folder_reports_broken_files(spark, tmp_path):
    from mailspark.operators.compact import AUTH8, HEADER16
    from mailspark.plans.dataset import upgrade_folder
    from mailspark.sources.documents import read_documents
    src = tmp_path / "docs" / "deep"
    src.mkdir(parents=True)
    old = {"email_id": "a", "headers": {"date": "d", "message_id": "m"}, "header_features": dict.fromkeys(HEADER16, 1)}
    new = {"email_id": "b", "headers": {}, "header_features": dict.fromkeys(HEADER16 + AUTH8, 2)}
    texts = {"a": json.dumps(old, indent=2), "b": json.dumps(new, indent=2), "c": json.dumps(old, indent=2)[:40], "d": "no json"}
    for name, text in texts.items():
        (src / f"{name}.json").write_text(text)
    report = upgrade_folder(spark, str(tmp_path / "docs"), str(tmp_path / "out"))
    assert {(r.source_path[-6], r.email_id, r.status) for r in report.collect()} == {
        ("a", "a", "upgraded"), ("b", "b", "unchanged"), ("c", None, "broken"), ("d", None, "broken")}
    back = {r.email_id: r.header_features.asDict() for r in read_documents(spark, str(tmp_path / "out"), multiline=False).collect()}
    assert back == {"a": dict.fromkeys(HEADER16, 1) | dict.fromkeys(AUTH8, 0), "b": dict.fromkeys(HEADER16 + AUTH8, 2)}


def test_rfecv_goes_on_after_a_stop(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F
    from mailspark.operators import importance as IM
    df = spark.range(120).select(F.col("id").alias("mail_id"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2 + F.col("id") % 3).alias("x"),
                                 (F.col("id") % 5).alias("y"), (F.col("id") % 7).alias("z"))
    run = dict(cols=["x", "y", "z"], k=2, num_trees=3)
    best, table = IM.rfecv(df, **run)
    fit, calls = IM.fit_pipeline, []

    def stopped(rows, current, *a):
        calls.append(len(current))
        if len(current) == 2 and stop:
            raise RuntimeError("stopped")
        return fit(rows, current, *a)

    monkeypatch.setattr(IM, "fit_pipeline", stopped)
    stop = True
    with pytest.raises(RuntimeError):
        IM.rfecv(df, **run, ledger=str(tmp_path / "rounds"))
    stop = False
    calls.clear()
    again, table2 = IM.rfecv(df, **run, ledger=str(tmp_path / "rounds"))
    assert sorted(set(calls)) == [1, 2]  # the round over three features is read
    assert again == best and sorted(table2.collect()) == sorted(table.collect())


def test_survivors():
    from mailspark.operators.importance import survivors
    assert survivors(["a", "b", "c"], [0.2, 0.1, 0.1], 1, 1) == ["a", "c"]
    assert survivors(["a", "b", "c"], [0.2, 0.1, 0.1], 5, 2) == ["a", "c"]
    assert survivors(["a"], [1.0], 1, 1) == ["a"]
