"""Column functions on planted values, with the Japanese defaults."""

import datetime

import pytest
from pyspark.sql import functions as F

from foundling.functions import classify, dates, html as H, records, text, urls

DAY = datetime.date


@pytest.mark.parametrize("t, want", [
    ("犬と猫", "dog"), ("ねこちゃん", "cat"), ("うさぎ", "unknown"), ("concatenate", "cat"), (None, "unknown"), ("", "unknown"),
])
def test_species(one, t, want):
    assert one(classify.species("t"), t=t) == want


@pytest.mark.parametrize("t, want", [("female", "female"), ("Male", "male"), ("去勢済オス", "male"), ("女の子", "female"), ("", "unknown"), (None, "unknown")])
def test_gender(one, t, want):
    assert one(classify.gender("t"), t=t) == want


def test_heading_beats_species_words(one):
    assert one(classify.species_of_heading("t"), t="譲渡猫と犬の話") == "cat"


@pytest.mark.parametrize("t, want", [("譲渡済みです", "adopted"), ("申込者あり", "pending"), ("譲渡希望者と交渉中です", "reserved"), ("募集中", "available")])
def test_status(one, t, want):
    assert one(classify.extended_status("t"), t=t) == want


@pytest.mark.parametrize("t, want", [
    ("2025年8月7日", DAY(2025, 8, 7)), ("２０２５年８月７日頃", DAY(2025, 8, 7)), ("R7.4.16", DAY(2025, 4, 16)), ("令和元年5月1日", DAY(2019, 5, 1)),
    ("2025/1/2", DAY(2025, 1, 2)), ("平成31年4月30日", DAY(2019, 4, 30)), ("2025-13-01", None), ("8-7", None), ("", None), (None, None),
])
def test_dates(one, t, want):
    assert one(dates.parse_date("t"), t=t) == want


def test_stamps(one):
    assert one(dates.legacy_stamp_to_jst("t"), t="20251112_050457") == "20251112_140457"
    assert one(dates.legacy_stamp_to_jst("t"), t="2025-11-12") is None
    assert one(dates.jst_iso(F.col("t").cast("timestamp")), t="2025-11-12 07:30:45") == "2025-11-12T16:30:45.000+09:00"


@pytest.mark.parametrize("link, want", [
    ("//host/a.png", "https://host/a.png"), ("/a.png", "https://x.jp/a.png"), ("a.png", "https://x.jp/p/q/a.png"), ("./a.png", "https://x.jp/p/q/a.png"),
    ("../a.png", "https://x.jp/p/a.png"), ("../../../a.png", "https://x.jp/a.png"), ("http://y/a", "http://y/a"), ("", None), (None, None),
])
def test_absolute(one, link, want):
    assert one(urls.absolute("t", F.lit("https://x.jp/p/q/i.html?z=/1/2")), t=link) == want


def test_images(one):
    raw = F.array(F.lit("a"), F.lit('{"url":"b","alt":""}'), F.lit(None).cast("string"), F.lit('{"alt":"x"}'))
    assert one(urls.image_urls(raw)) == ["a", "b"]


def test_context_stays_in_the_sentence(one):
    t = "とても元気です。性格はおとなしいです。人が好き。"
    assert one(text.keyword_context("t", "性格", 30), t=t) == "性格はおとなしいです"
    assert one(text.first_keyword("t", ["洋猫", "雑種"]), t="雑種か洋猫") == "洋猫"
    assert one(text.first_in_text("t", ["洋猫", "雑種"]), t="雑種か洋猫") == "雑種"


@pytest.mark.parametrize("days, want", [(-3, "urgent"), (0, "urgent"), (3, "urgent"), (4, "warning"), (7, "warning"), (8, "caution"), (14, "caution"), (15, "normal")])
def test_urgency_steps(one, days, want):
    today = F.lit("2025-06-15").cast("date")
    assert one(classify.urgency_level(F.date_add(today, days), today)) == want


def test_started_day_does_not_count(one):
    noon = F.lit("2025-06-15 12:00:00").cast("timestamp")
    left = lambda d: one(classify.days_remaining(F.lit(d).cast("date"), noon))
    assert [left("2025-06-16"), left("2025-06-17"), left("2025-06-01"), left(None)] == [0, 1, 0, None]
    assert one(classify.urgency_level(F.lit(None).cast("date"), noon.cast("date"))) == "normal"


def test_ids_and_genders(one):
    pair = records.zip_ids(records.id_list(F.lit("管理番号：HC25374(松岡)")), records.gender_counts(F.lit("オス：2匹、メス:1匹")))
    got = [(r["external_id"], r["gender"]) for r in one(pair)]
    assert got == [("HC25374-1", "male"), ("HC25374-2", "male"), ("HC25374-3", "female")]


def test_positional_record(one):
    r = one(records.positional_record("t"), t=" 7東－C0054   R7.4.16   雑種   キジトラ   オス  去勢済   検査 未実施   ・もりもり 食べる")
    assert (r["external_id"], r["birth_date"], r["color"], r["gender"], r["neutered"], r["felv"], r["fiv"], r["notes"]) == (
        "7東－C0054", DAY(2025, 4, 16), "キジトラ", "male", True, "not_tested", "not_tested", "・もりもり 食べる",
    )
    assert one(records.positional_record("t"), t="見出し") is None


def test_card_lines(one):
    r = one(records.card_lines("t"), t="No.7002\n アイ（オス）\n備考")
    assert (r["external_id"], r["name"], r["gender"]) == ("7002", "アイ", "male")


def test_script_text_is_no_token(one):
    page = '<script>var t="</p>"</script><p>x<p>y</p>'
    assert one(H.tokens(text.strip_code("t")), t=page) == ["<p>", "x", "<p>", "y", "</p>"]
    assert one(H.elements("t", "p"), t="<p>x<p class=a>y</p><pre>z</pre>") == ["x", "y"]


def test_attributes_in_any_quotes(one):
    assert [one(H.attr("t", "src"), t=t) for t in ('<img src="a b">', "<img src='a'>", "<img src=a>", '<img data-src="x">', "<img>")] == [
        "a b", "a", "a", None, None,
    ]


def test_containers_nest(one):
    page = '<div class="a"><div>1</div>2</div><div class="ab">no</div><div class=\'x a\'>3'
    assert one(H.containers("t", "div", ["a"]), t=page) == ['<div class="a"><div>1</div>2</div>', "<div class='x a'>3"]


def test_record_count_steps(one):
    n = lambda t: one(H.record_count("t"), t=t)
    assert n("<table><tr><th></tr><tr></tr><tr></tr></table>") == 2
    assert n('<tr></tr><div class="big card">') == 1
    assert n('<a href="/detail/1"><a href="/detail/2">') == 2
    assert n('<img src="a.png"><img src="logo.png">') == 1
    assert n("nothing") == 0


def test_labelled_values(one):
    t = "仮名紅蘭（クラン）種類トイプードル推定年齢２歳性別メス毛色茶色更新日2025年"
    get = lambda *n, **k: one(text.labelled("t", n, **k), t=t)
    assert [get("仮名"), get("種類"), get("推定年齢", "年齢"), get("性別"), get("毛色")] == ["紅蘭（クラン）", "トイプードル", "２歳", "メス", "茶色"]
    assert get("毛色", char_class_stop=True) == "茶"


def test_delimited_attributes(one):
    r = one(records.delimited_attributes("t"), t="雑種、8才齢（推定）、オス、白茶、中型（18.1キログラム）、パワフル、去勢済み")
    assert tuple(r) == ("雑種", "8才齢（推定）", "male", "白茶", "medium", 18.1, "去勢済み", "パワフル")
