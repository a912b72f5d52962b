"""The ledger's stream against counting its lines."""

import json
from collections import Counter

import pytest

from graphloom.streaming import ledger


def line(key, to, **more):
    return json.dumps({"key": key, "to": to} | more) + "\n"


def counts(text):
    out = Counter()
    for x in text.split("\n")[:-1]:
        try:
            r = json.loads(x)
        except ValueError:
            continue
        if isinstance(r, dict) and r.get("key") is not None:
            out[r["key"], r.get("to")] += 1
    return dict(out)


def folded(spark, path, folder):
    return {(r["key"], r["to"]): r["have"] for r in ledger.fold(spark, path, folder).collect()}


def test_appends_torn_lines_truncation_and_rewriting(spark, tmp_path):
    path, folder = tmp_path / "audit.jsonl", f"file://{tmp_path}/folds"
    folds = lambda: sorted(p.name for p in (tmp_path / "folds").iterdir())
    text = "".join(line(f"k{i % 3}", "grounded" if i % 2 else "failed") for i in range(20)) + "no json\n[1]\n\n"
    path.write_text(text + '{"key": "torn", "to"')
    assert folded(spark, str(path), folder) == counts(text)
    text += line("torn", "rejected") + line("k0", "failed")
    path.write_text(text)
    assert folded(spark, str(path), folder) == counts(text) and folds() == ["fold-0"]
    assert folded(spark, str(path), folder) == counts(text) and folds() == ["fold-0"]  # nothing new
    text = text.replace("k1", "q1") + line("k2", "failed")  # as long as before, and more
    path.write_text(text)
    assert folded(spark, str(path), folder) == counts(text) and folds() == ["fold-0", "fold-1"]
    text = text[: text.index("\n", 200) + 1]
    path.write_text(text)
    assert folded(spark, str(path), folder) == counts(text) and folds() == ["fold-0", "fold-1", "fold-2"]
    text += line("new", "grounded")
    path.write_text(text)
    assert folded(spark, str(path), folder) == counts(text) and folds() == ["fold-0", "fold-1", "fold-2"]


@pytest.mark.parametrize("size", [1, 7, 40, 1 << 20])
def test_ranges_give_each_line_once(tmp_path, monkeypatch, size):
    monkeypatch.setattr(ledger, "RANGE", size)
    path = tmp_path / "l"
    text = "".join(line(f"k{i}", "x" * (i * 13 % 60)) for i in range(30)) + "\n" + line("é中", "y") + '{"key": "torn'
    path.write_text(text)
    reader = ledger.LedgerReader(str(path))
    end = reader.latestOffset()
    rows = [r for p in reader.partitions(reader.initialOffset(), end) for r in reader.read(p)]
    assert sorted((r[0], r[2]) for r in rows) == sorted((json.loads(x)["key"], json.loads(x)["to"]) for x in text.split("\n")[:-1] if x)
    part = len("".join(text.splitlines(True)[:9]).encode())
    middle = {"files": {str(path): [part, ledger._digest(str(path), part)]}}
    later = [r for p in reader.partitions(middle, end) for r in reader.read(p)]
    assert len(later) == len(rows) - 9
    path.write_text("x" + text)
    with pytest.raises(ledger.LedgerChanged):
        reader.partitions(middle, end)
    path.write_text(text[:50])
    with pytest.raises(ledger.LedgerChanged):
        reader.partitions(middle, middle)


def test_a_folder_of_files_that_grow_and_one_that_goes(spark, tmp_path):
    path, folder = tmp_path / "l", f"file://{tmp_path}/folds"
    path.mkdir()
    texts = {f"part-{k}": "".join(line(f"k{i % 4}", "failed") for i in range(k, 12)) for k in range(3)}

    def put(**more):
        texts.update(more)
        for name, text in texts.items():
            (path / name).write_text(text)
        (path / "_SUCCESS").write_text("no ledger\n")
        return counts("".join(texts.values()))

    put()
    assert folded(spark, f"file://{path}", f"{folder}-uri") == put()
    assert folded(spark, str(path), folder) == put()
    want = put(**{"part-9": line("new", "rejected")})
    assert folded(spark, str(path), folder) == want
    (path / "part-1").unlink()
    del texts["part-1"]
    assert folded(spark, str(path), folder) == counts("".join(texts.values()))


def test_no_ledger_yet(spark, tmp_path):
    assert folded(spark, str(tmp_path / "none"), f"file://{tmp_path}/folds") == {}
