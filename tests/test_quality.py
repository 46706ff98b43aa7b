"""Decoding, useless and blank pages, fingerprints, phrases, redirects."""

import random

import pytest
from pyspark.sql import functions as F

from sitegrain.constants import USELESS_PHRASES
from sitegrain.operators import patterns, quality, redirects

HANZI = "网站维护中，请稍后再访问此站点。如果您仍然遇到问题，请与网站的管理员联系。这是一段普通的中文文字，用来测试编码。"


def test_decode(spark):
    cases = [
        ("plain".encode(), "plain"),
        ("größe é".encode(), "größe é"),
        (b"\xef\xbb\xbfbom", "bom"),
        (HANZI.encode("gb18030"), HANZI),
        ("文字".encode("utf-16"), "文字"),
        (b"", ""),
        (None, ""),
        (b"\xff\x80\x81", None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, content binary")
    got = dict(quality.decode_pages(df).select("i", "page_text").collect())
    for i, (_, want) in enumerate(cases):
        if want is not None:
            assert got[i] == want
    assert got[7] is not None


def test_useless_needs_a_phrase_and_a_short_text(spark):
    phrase = "404 Not Found"
    texts = [phrase.ljust(n, ".") for n in (999, 1000)] + ["fine", "", None, "😀" * 986 + phrase]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id int, html string")
    assert [r.page_id for r in quality.drop_useless_pages(df).collect()] == [1, 2, 3, 4]
    kept = quality.drop_useless_pages(df, phrases=["(?i)fine", "a\\Eb"]).count()
    assert kept == len(texts)
    many = [f"p{i}q" for i in range(5000)] + ["fine"]
    assert quality.drop_useless_pages(df, phrases=many).count() == len(texts) - 1


PARAGRAPHS = {
    "euc-kr": "대한민국의 수도는 서울이며 인구가 가장 많은 도시이다. 한강을 중심으로 남북으로 나뉘어 있으며 정치와 경제와 문화의 중심지이다.",
    "euc-jp": "日本国憲法前文。日本国民は、正当に選挙された国会における代表者を通じて行動し、われらとわれらの子孫のために、諸国民との協和による成果を確保する。",
    "gb18030": "北京是中华人民共和国的首都，是全国的政治中心和文化中心。这座城市有三千多年的建城历史，名胜古迹众多，每年吸引大量游客前来参观。",
}


def test_paragraphs_in_other_charsets(spark):
    rows = [(name, text.encode(name)) for name, text in PARAGRAPHS.items()]
    rows.append(("short", "网站维护中".encode("gb18030")))
    df = spark.createDataFrame(rows, "name string, content binary")
    got = dict(quality.decode_pages(df).select("name", "page_text").collect())
    assert got == {**PARAGRAPHS, "short": "网站维护中"}


IN_CHARSETS = {
    ("euc-kr", "cp949"): "안녕하세요 세계 여러분, 오늘은 날씨가 참 좋습니다. 우리는 서울에서 부산까지 기차를 타고 갔습니다.",
    ("euc-jp", "shift_jis"): "これは日本語の文章です。カタカナとひらがなと漢字をまぜて書きます。東京の天気は晴れでした。",
    ("gb18030", "gb2312"): "今天天气很好，我们一起去公园散步，看见很多人在湖边拍照。请不要忘记带上你的相机和雨伞。",
    ("big5",): "今天天氣很好，我們一起去公園散步，看見很多人在湖邊拍照。請不要忘記帶上你的相機和雨傘。",
    ("koi8-r", "cp1251"): "Привет, мир! Сегодня хорошая погода, и мы пошли гулять в парк вместе с друзьями из Москвы.",
    ("cp1252",): "Überraschung à la carte: où est passé l’été? Señor Núñez vive en España, größer und schöner.",
    ("cp1253",): "Καλημέρα κόσμε, σήμερα ο καιρός είναι πολύ καλός και πήγαμε βόλτα στο πάρκο με τους φίλους.",
    ("cp1255",): "שלום עולם, היום מזג האוויר טוב מאוד והלכנו לטייל בפארק עם החברים שלנו מירושלים.",
    ("cp1256",): "مرحبا بالعالم، الطقس جميل اليوم وذهبنا إلى الحديقة مع أصدقائنا من المدينة القديمة.",
    ("cp874",): "สวัสดีชาวโลก วันนี้อากาศดีมากและเราไปเดินเล่นในสวนสาธารณะกับเพื่อนของเรา",
}


@pytest.mark.parametrize("markup", ["", "<p class=x>"])
def test_short_and_long_texts_in_charsets(spark, markup):
    """The first 8 characters that need the charset, whole texts, and 500 characters."""
    rows = []
    for charsets, text in IN_CHARSETS.items():
        start = next(i for i, c in enumerate(text) if c > "\x7f")
        texts = {markup + t for t in (text[start : start + 8], text, (text + " ") * 10)}
        rows += [(f"{c} {len(t)}", t, t.encode(c)) for c in charsets for t in sorted(texts)]
    df = spark.createDataFrame(rows, "name string, want string, content binary")
    wrong = [(r.name, r.want[:20], r.page_text[:20]) for r in quality.decode_pages(df).collect() if r.page_text != r.want]
    assert wrong == []


def test_words_of_accented_letters_alone_are_latin(spark):
    texts = [
        "Anaieux éé èçou éç.",
        "Onqueque de èê de, du.",
        "Çèen en vich de.",
        "Le ouou de èvitre, pour la èéè de pour éè de.",
        "Pfeinung ensttzer von, die ää des auung dem in.",
        "ÇÉ!! ÊELLE!! OURÉ!! QUECHLE,!! ÈÊ.\nDE!! AU!! È!! ÈÉÊ!! ÉQUETION,!! LES!! RÉÉ!! EAUEAURÉ!!",
    ]
    df = spark.createDataFrame([(t, t.encode("latin-1")) for t in texts], "want string, content binary")
    assert [(r.want, r.page_text) for r in quality.decode_pages(df).collect() if r.page_text != r.want] == []


def test_bytes_of_no_charset_are_empty(spark):
    cut = [IN_CHARSETS["big5",].encode("big5")[:-1], "größe".encode() + b"\xc3 und " + "größer".encode(), b"\xff\xfe\x00"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cut)], "i int, content binary")
    assert {r.page_text for r in quality.decode_pages(df).collect()} == {""}


def test_every_phrase_is_found(spark):
    df = spark.createDataFrame([(i, "x" + p + "y") for i, p in enumerate(USELESS_PHRASES)], "page_id int, html string")
    assert quality.drop_useless_pages(df).count() == 0


def test_blank(spark):
    df = spark.createDataFrame([(1, b""), (2, None), (3, b" ")], "page_id int, html binary")
    assert [r.page_id for r in quality.drop_blank_pages(df).collect()] == [3]


def test_phrases_overlap_and_repeat(spark):
    texts = spark.createDataFrame([(1, "ushers"), (2, "aaaa"), (3, None), (4, "zz")], "id int, text string")
    phrases = spark.createDataFrame([(p,) for p in ("he", "she", "his", "hers", "aa", "aa", "")], "pattern string")
    found = patterns.match_patterns(texts, phrases, "id", "text")
    assert {tuple(r) for r in found.collect()} == {(1, "he", 1), (1, "she", 1), (1, "hers", 1), (2, "aa", 3)}


def test_random_phrases_against_brute_force(spark):
    rnd = random.Random(7)
    word = lambda a, b: "".join(rnd.choice("ab中") for _ in range(rnd.randint(a, b)))
    texts, phrases = [(i, word(0, 40)) for i in range(200)], {word(1, 4) for _ in range(40)}
    found = patterns.match_patterns(
        spark.createDataFrame(texts, "id int, text string"),
        spark.createDataFrame([(p,) for p in phrases], "pattern string"),
        "id",
        "text",
    )
    count = lambda t, p: sum(t.startswith(p, i) for i in range(len(t)))
    want = {(i, p, count(t, p)) for i, t in texts for p in phrases if p in t}
    assert {tuple(r) for r in found.collect()} == want


def test_phrases_of_words_against_brute_force(spark):
    """Words, single characters, punctuation, repeated keys and rows, and overlapping phrases."""
    rnd = random.Random(8)
    words = lambda a, b: "".join(rnd.choice(["ab", "a", "ba", "中文", "é1", "😀"]) + rnd.choice([" ", " ", "-", "", "\\E", "."]) for _ in range(rnd.randint(a, b)))
    texts = [(i % 150, words(0, 30)) for i in range(200)] + [(None, "a ab a ab a"), (7, None), (8, "a ab a ab a"), (8, "a ab a ab a")]
    phrases = {words(1, 4) for _ in range(80)} | {"a ab a", " ", "a", "\\E"}
    found = patterns.match_patterns(
        spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(p,) for p in phrases], "pattern string"), "id", "text"
    )
    count = lambda t, p: sum(t.startswith(p, i) for i in range(len(t)))
    want = sorted(((i, p, count(t, p)) for i, t in texts if t for p in phrases if p in t), key=repr)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want


def test_no_phrases(spark):
    texts = spark.createDataFrame([(1, "x")], "id int, text string")
    assert patterns.match_patterns(texts, spark.createDataFrame([], "pattern string"), "id", "text").count() == 0


URL = "http://h.com/p"
BODIES = [
    ('<head><meta http-equiv="refresh" content="0;url=/n"></head>', "meta", "http://h.com/n"),
    ("<head><meta http-equiv=\"refresh\" content=\"0; URL='/n'\"></head>", None, None),
    ('<head><meta content="0;url=http://h.com/p"></head>', None, None),
    ('<head><script>window.onload=function(){top.location.href="/o"}</script></head>', "onload", "http://h.com/o"),
    ('<body><script>window.location.href="/s"</script></body>', "body_script", "http://h.com/s"),
    ('<body><script>window.location.href="/s"</script>' + " x" * 60 + "</body>", None, None),
    ("<head></head><body>" + "long " * 60 + '<script>location="/l"</script></body>', "script", "http://h.com/l"),
    ('<script>location=""</script>', None, None),
    ('<body>top.location.href="" window.location.href="/s"</body>', None, None),
    ('self.location.href=" /t "', "body_script", "http://h.com/t"),
    ("nothing", None, None),
    (None, None, None),
]


def test_redirect_rules(spark):
    df = spark.createDataFrame([(i, URL, b[0]) for i, b in enumerate(BODIES)], "page_id int, url string, html string")
    got = {r.page_id: (r.kind, r.target) for r in redirects.detect_redirects(df).collect()}
    assert got == {i: b[1:] for i, b in enumerate(BODIES) if b[1]}


def test_following_takes_the_first_target_that_exists(spark):
    both = (
        '<head><meta content="0;url=/gone"><script>window.onload=function(){top.location.href="/o"}</script></head>'
    )
    df = spark.createDataFrame(
        [
            ("http://h.com/p", both),
            ("http://h.com/o/", "found"),
            ("http://h.com/q", '<head><meta content="0;url=/gone"></head>'),
            ("http://h.com/r", '<head><meta content="0;url=/p"></head>'),
            ("http://h.com/n", None),
        ],
        "url string, html string",
    )
    got = {r.url[-2:]: (r.html, r.redirect_kind) for r in redirects.follow_redirects(df).collect()}
    assert got["/p"] == ("found", "onload")
    assert got["o/"] == ("found", None)
    assert got["/q"] == ('<head><meta content="0;url=/gone"></head>', None)
    assert got["/r"] == (both, "meta")
    assert got["/n"] == (None, None)


def test_following_with_several_pages_of_a_url(spark):
    to = lambda target: f'<head><meta content="0;url={target}"></head>'
    rows = [
        (1, "http://h.com/a", to("/b")),
        (2, "http://h.com/a", to("/c/")),
        (3, "http://h.com/a", "stays"),
        (4, "http://h.com/b", "b one"),
        (5, "http://h.com/b", "b two"),
        (6, "http://h.com/c", "c"),
        (7, "http://h.com/c/", "c slash"),
    ]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = sorted((r.page_id, r.html) for r in redirects.follow_redirects(df).collect())
    assert got == [(1, "b one"), (1, "b two"), (2, "c slash"), (3, "stays"), (4, "b one"), (5, "b two"), (6, "c"), (7, "c slash")]
