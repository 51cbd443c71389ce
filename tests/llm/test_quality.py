import os

import pytest

from loglattice.functions.layouts import Router
from loglattice.llm import quality

COMMON = frozenset("the of and to in a is that it was for on with as at by this be we not der die das und es wir nicht auf".split())
R = Router()
PROSE = "When we looked again, the broker refused 21 receipts without any warning. It was the archive that had written to the same place, and nobody on the team saw it.\n\nWe kept it for a day."
TEXTS = {
    "prose": (PROSE, True),
    "wrapped": ("We kept the remote bucket for 13 days and then removed it\nfrom the pool. By then both workers lost a stale bucket, but\nonly for 18 users; the spooler compared it to the\nlast one.", True),
    "unpunctuated": ("since nobody was on call we refused the bucket because the broker was stale\nwhen we looked again it was in the pool and we left it there as it was\n", True),
    "short": ("Both workers refused a cold bucket.", True),
    "bullets": ("- restart the pool\n- wait for the index\n- it is the last of the queue\n" * 4, False),
    "plain list": ("restart the pool\nwait 5 minutes\nowner of the archive\nread the log\n" * 4, False),
    "key value": ("restart the pool = 5\nowner of the index = none\nread the log = 17\n" * 3, False),
    "comma list": ("the pool, the archive, the index, iris, cedar, the mirror, the queue, amber, the cache, the log, " * 4, False),
    "pipe table": ("| a | what to do with the log | c |\n|---|---|---|\n" + "| the pool | wait for the index of it | 5 |\n" * 5, False),
    "box table": ("┌─────┐\n" + "│ the pool │ wait for the index of the queue │ 5 │\n" * 5, False),
    "csv": ("name,task,size\n" + "pool,wait for the index,5\n" * 6, False),
    "columns": ("first     what it is to do       count\n" + "the pool  wait for the index     5\n" * 5, False),
    "log": ("2023-01-09T11:31:02.583Z WARN  [svc-a] it was not to be of use to the pool\n\tat io.x.Y(Z.java:1)\n" * 4, False),
    "common junk": ("the of and to in a is that it was for on with as at by this be we not " * 5, False),
    "random junk": ("grcnzqcxb mtaatwqnw gkeawgfxbf faxkjwrtv gxfykgagf nmglcekrgl esslxndxvaqkn " * 5, False),
    "symbols": ("^]~&<- @.}})\\/[|/~]# (%::[(>-[&+ )-:[)@{\\[&+_]$- -]*\\^&.\\^}\n" * 5, False),
    "repeated": ("what to do with the cart and the pool " * 20, False),
    "indented list": ("the first of the machines in the east that it was on\n    with the owner of it and all of its parts as they are\n    with the place it was put to by the team of the night\n" * 5, False),
    "form": ("what it is that the team of the east was to do with it\nit was not done and so\nand who it was that had it for the night in the end of it all\n" * 6, False),
    "glyphs": ("it was the last of the !! ## && ** (( )) of it and that is ++ -- == // the one for it <> <> .\n" * 3, False),
    "stars": ("*" * 500, False),
}


@pytest.mark.parametrize("name", TEXTS)
def test_verdicts(name):
    text, prose = TEXTS[name]
    stats = quality.text_stats(text, COMMON, R)
    assert quality.is_prose(stats) is prose, stats


def test_structure_measures():
    assert all(quality.delimiter_alignment(["a;b;c"] * 4, "a;b;c"))
    assert not any(quality.delimiter_alignment(["One, two.", "Then, we left it there, and so on."], ","))
    assert quality.indent_period(["- a", "  - b", "- a", "  - b", "- a", "  - b"]) > 0.5
    assert quality.indent_period(["a", "b", "c"]) == 0 == quality.indent_period(["  a", "  b", "  c"])
    assert quality.autocorrelation([1.0, 1.0, 1.0, 1.0], 1) == 1.0 and quality.autocorrelation([1.0], 1) == 0.0
    assert quality.repetition("a b c".split() * 20) > 0.9


@pytest.mark.parametrize("name", ["indented list", "form"])
def test_structure_decides(monkeypatch, name):
    """Without the period of indentation and the correlation of line lengths these lists would count as prose."""
    monkeypatch.setattr(quality, "list_structure", lambda lines: 0.0)
    assert quality.is_prose(quality.text_stats(TEXTS[name][0], COMMON, R))


def test_alignment_and_ratios_decide(monkeypatch):
    columns = "it was for the team    the last of it all    as it was\n" * 5
    assert not quality.is_prose(quality.text_stats(columns, COMMON, R))
    stats = quality.text_stats(PROSE, COMMON, R)
    assert quality.is_prose(stats)
    for name, value in [("symbol_ratio", 0.5), ("mean_word_length", 1.5), ("mean_word_length", 15.0)]:
        assert not quality.is_prose([value if c == name else x for c, x in zip(quality.STATS, stats)])
    bare = dict(zip(quality.STATS, stats)) | {"common_words": 0.0, "punctuated_lines": 0.1}
    assert not quality.is_prose([bare[c] for c in quality.STATS]) and quality.is_prose([(bare | {"punctuated_lines": 1.0})[c] for c in quality.STATS])
    monkeypatch.setattr(quality, "delimiter_alignment", lambda lines, text: [False] * len(lines))
    assert quality.is_prose(quality.text_stats(columns, COMMON, R))


def test_table(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, PROSE), (4, PROSE), (None, "x" * 300_000), (6, PROSE * 500)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, is_prose string")
    got = quality.quality(df, "text", ["doc_id"], COMMON).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and by[1]["is_prose"] is None and by[1]["n_words"] is None
    assert by[2]["is_prose"] is None and by[2]["n_words"] == 0 and by[3]["is_prose"] is None
    assert by[4]["is_prose"] and not by[None]["is_prose"] and by[6]["is_prose"]
    assert quality.quality(df.limit(0), "text", ["doc_id"], COMMON).count() == 0


def test_common_words_are_few(spark):
    words = spark.createDataFrame([("en", "The"), ("de", "the"), ("de", None)], "lang string, word string")
    assert quality.common_words(words) == {"the"}
    with pytest.raises(ValueError):
        quality.common_words(spark.range(20_000).selectExpr("cast(id as string) as word"))


LABELS = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(LABELS), reason="no labelled documents here")
def test_against_labels(spark):
    """The constants were set on labels with even doc_id; the other half is held out."""
    common = quality.common_words(spark.read.parquet(f"{LABELS}/common_words.parquet"))
    docs = spark.read.parquet(f"{LABELS}/documents.parquet")
    got = quality.quality(docs, "text", ["doc_id"], common).join(spark.read.parquet(f"{LABELS}/doc_labels.parquet"), "doc_id")
    n, right = got.where("doc_id % 2 = 1").selectExpr("count(*)", "count_if(is_prose = (kind = 'prose'))").first()
    assert n > 100 and right >= 0.98 * n
