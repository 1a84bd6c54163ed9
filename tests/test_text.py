"""Text and path expressions, with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from fathomdex.config import Root, Settings, build_roots, parse_folders, positive
from fathomdex.functions import paths, text
from fathomdex.operators import chunking, reading
from fathomdex.sources.extract import plain


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(f(*[F.col(f"c{k}") for k in range(len(values))])).first()[0]


HTML = [
    ("<p>a</p>b", "a\nb"),
    ("<script>x\ny</script>a<STYLE>q</style>  \t b", "a b"),
    ("a<br>b<BR />c<h2>d</H2>e", "a\nb\nc d\ne"),
    ("&amp;lt;i&gt; &quot; &#x41; &nbsp;x", "<i> &quot; &#x41; x"),
    ("&#225;&#8364;&#128512;", "á€" + chr(128512 % 65536)),
    ("a</p></p></p></p>b", "a\n\nb"),
    ("  x 　", "x"),
    ("", ""),
]


@pytest.mark.parametrize("html, want", HTML)
def test_html(spark, html, want):
    assert one(spark, text.html_to_text, html) == want == plain.html_to_text(html)


@pytest.mark.parametrize(
    "xml, want",
    [("<text:p>a<text:tab/>b</text:p><text:p>c</text:p>", "a b \nc"), ("<a:t>x</a:t><a:br/>y</a:p>z", "x \ny\nz"), ("&quot;&apos;&amp;#65;", "\"'A"), ("<text:line-break/>a", "a")],
)
def test_office(spark, xml, want):
    got = one(spark, text.office_xml_to_text, xml)
    assert got == plain.office_xml_to_text(xml)
    assert got.replace(" ", "") == want.replace(" ", "")


IOS = "[12/03/24, 9:41:03] Ana: hola\nmas\n\n[12/03/24, 9:42:00] Luis: ya"
ANDROID = "aviso\n12/3/24, 9:41 - Ana: hola: si\n12.3.2024, 10:41 PM - Luis: ok"


def test_chat(spark):
    assert one(spark, text.join_chat, IOS) == "Ana: hola mas \nLuis: ya" == plain.joined_chat(IOS)
    assert one(spark, text.join_chat, ANDROID) == "aviso\nAna: hola: si\nLuis: ok" == plain.joined_chat(ANDROID)
    assert one(spark, text.is_chat, IOS) is True
    assert one(spark, text.is_chat, "no\nchat\nhere") is False
    assert one(spark, text.is_chat, "\n\n") is False
    six = "12/3/24, 9:41 - A: x\n" * 6
    assert one(spark, text.is_chat, six + "y\n" * 4) is True
    assert one(spark, text.is_chat, six + "y\n" * 5) is False


def test_csv_rows(spark):
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    row = spark.range(1).select(
        text.is_header(arr("a", "1")), text.is_header(arr("1", "-2,5", "")), text.labelled_row(arr("a", "b", "c"), arr("1", "", "3", "4")), text.labelled_row(arr("a"), arr("")),
        text.joined_row(arr("1", "", "2")),
    ).first()
    assert list(row) == [True, False, "a: 1 | c: 3", None, "1 |  | 2"]


def test_versions(spark):
    assert one(spark, text.version_newer, "1.10", "1.9.9") is True
    assert one(spark, text.version_newer, "1.2", "1.2.0") is False
    assert one(spark, text.version_newer, "v2", "1") is False


def test_words_and_pages(spark):
    assert one(spark, text.words, " a　b\x0bc﻿d e\u0085f ") == ["a", "b", "c", "d", "e\u0085f"]
    assert one(spark, text.pages_from_text, " ﻿ ") == []


@pytest.mark.parametrize("n, count", [(0, 0), (1, 1), (364, 1), (365, 1), (366, 2), (685, 2), (686, 3)])
def test_window_count(spark, n, count):
    got = one(spark, lambda t: chunking.windows(t, 365, 45), " ".join(map(str, range(n))))
    assert len(got) == count
    assert [w for g in got for w in g.split()] == [str(i) for k in range(count) for i in range(k * 320, min(n, k * 320 + 365))]


def test_sizes():
    assert chunking.sizes() == (365, 45)
    assert chunking.sizes(1, 64) == (1, 0)


def test_page_span():
    assert reading.page_span(None, None) == (0, 60)
    assert reading.page_span(-1, 0) == (0, 60)
    assert reading.page_span(3, 61) == (3, 60)
    assert reading.page_span(1, -1) == (1, 1)


def test_markers(spark):
    rows = [("a", k, p, f"t{k}") for k, p in enumerate([1, 1, None, 1, 2])] + [("b", 0, None, "x"), ("b", 1, None, "y")]
    df = spark.createDataFrame(rows, "doc_id string, chunk_id int, page int, texto string")
    got = {r["doc_id"]: r for r in reading.assembled(df).collect()}
    assert got["a"]["texto"] == "[pág. 1]\nt0\nt1\nt2\nt3\n\n\n[pág. 2]\nt4"
    assert got["b"]["texto"] == "x\ny"
    past = reading.assembled(df, 9, 5).where("doc_id = 'a'").first()
    assert (past["texto"], past["hasta_fragmento"], past["siguiente_fragmento"]) == ("", 5, None)


def test_folders_and_roots(spark):
    assert parse_folders('["/a", " /b "]') == ["/a", "/b"]
    assert parse_folders("/a;/b,/c\n") == ["/a", "/b", "/c"]
    assert parse_folders("[bad") == [] and parse_folders(None, "/x") == ["/x"]
    assert [r.name for r in build_roots(["/a/x", "/b/x", "/c/x"])] == ["x", "x-2", "x-3"]
    assert positive("0", 5) == 5 and positive("12abc", 5) == 12 and positive(None, 5) == 5
    assert Settings.from_env({"FATHOMDEX_FOLDERS": "/q/r", "FATHOMDEX_OCR": "false"}).ocr is False
    roots = [Root("a", "/d/a"), Root("in", "/d/a/b")]
    assert one(spark, lambda p: paths.root_of(p, roots), "/d/a/b/c.txt") == "in"
    assert one(spark, lambda p: paths.logical_path(p, roots), "/d/a/b/c.txt") == "in/c.txt"
    assert one(spark, lambda p: paths.logical_path(p, roots), "/d/ab/c.txt") == "c.txt"
    assert one(spark, paths.extension, "/a/.txt") == "" and one(spark, paths.extension, "/a/b.TXT") == ".txt"


@pytest.mark.parametrize("folder, path, want", [(None, "a/b", True), ("a", "a/b", True), ("a", "ab", False), ("\\a\\", "/a/b/", True), ("//", "a", False), ("A", "a", False)])
def test_folder_filter(spark, folder, path, want):
    assert one(spark, lambda p: paths.in_folder(p, folder), path) is want
