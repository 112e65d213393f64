"""Documents in order, by select alone."""

from tabweave.llm.elias_fano import EliasFano
from tabweave.llm.token_files import TokenFile, TokenFileWriter


def test_documents_come_by_select(tmp_path, monkeypatch):
    monkeypatch.setattr(EliasFano, "values", None)
    w = TokenFileWriter(f"file://{tmp_path}/x", 2)
    for i in range(1500):
        w.add(None if i < 3 else 7 * i, b"\1\0" * (i % 5))
    w.close()
    f = TokenFile(f"file://{tmp_path}/x")
    got = [(d, s, x.tolist()) for d, s, x in f.documents()]
    assert got == [(d, s, x.tolist()) for d, s, x in map(f.document, range(len(f)))] and len(got) == 1500
