import io
import re

import pytest

from textquarry import Mode, cli
from textquarry.journal import Journal
from textquarry.plans import store
from textquarry.streaming.append import load_stream_index, start_indexing, stream_texts


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("cli")
    (place / "in").mkdir()
    (place / "in/a.txt").write_text("some metal met me\nis it of the one\n")
    assert cli.main(["build", str(place / "in"), str(place / "index")]) == 0
    return str(place / "index")


def test_search(root, capsys):
    cli.main(["search", root, "word", "prefix", " me ", "--tokens-only"])
    assert capsys.readouterr().out.split() == ["met", "metal"]
    cli.main(["search", root, "line", "contains", "of the"])
    assert re.fullmatch(r"#1 -> is it \[of the\] one\n\d+\.\d{3} s\n", capsys.readouterr().out)
    with pytest.raises(SystemExit):
        cli.main(["search", root, "word", "prefix", "  "])
    with pytest.raises(SystemExit):
        cli.main(["search", root, "page", "prefix", "me"])


def test_shell_keeps_the_index(spark, root):
    out = io.StringIO()
    lines = ["word prefix me\n", "\n", "word prefix\n", "page prefix x\n", "word prefix M3\n", "line contains of the\n", ":log\n", ":quit\n", "word prefix s\n"]
    cli.shell(spark, root, Mode.COMPAT, 100, lines, out)
    said = out.getvalue()
    assert "#1 -> [me]t\n#2 -> [me]tal\n" in said and "is it [of the] one" in said and "[s]ome" not in said
    assert said.count("? ") == 3
    assert re.search(r"\d\d:\d\d:\d\d\.\d{3} search word prefix 'me' in the index of trie", said)
    assert "word prefix 'me': 2 results in" in said and "loaded 6 indexes" in said and said.count("loaded") == 1


def test_journal_keeps_the_last():
    import logging

    with Journal(3) as journal:
        for k in range(5):
            logging.getLogger("textquarry.x").debug("message %d", k)
    logging.getLogger("textquarry.x").debug("after")
    assert [m.split(" ", 1)[1] for m in journal.messages] == ["message 2", "message 3", "message 4"]


def test_stream_compacts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    root, words = str(tmp_path / "index"), ["me", "met", "home", "so"]
    assert all(x.count() == 0 for x in load_stream_index(spark, root).values())
    for k, w in enumerate(words):
        (tmp_path / f"in/{k}.txt").write_text(f"{w} the\n")
        start_indexing(stream_texts(spark, str(tmp_path / "in")), root, str(tmp_path / "ck"), compact_every=2).awaitTermination()
    held = store.version(spark, root)
    assert len(held.segments) <= 2 and any(store.version(spark, root, n).kind == "compact" for n in store.versions(spark, root))
    counts = {r.token: r.freq for r in store.load(spark, root)[next(k for k in store.ALL if k[0].value == "word")].collect()}
    assert counts == {"me": 1, "met": 1, "home": 1, "so": 1, "the": 4}
