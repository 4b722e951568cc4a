"""Small pages in the facilities' layouts."""

import pytest

from foundling.operators import extract
from foundling.sources import layouts

PAGES = [
    ("ishikawa/aigo-ishikawa", '<div class="x data_box">No.12 仮名紅蘭 種類トイプードル推定年齢２歳性別メス毛色茶 <img src="/i/a.jpg"></div><div class="data_box">仮名太郎性別オス</div>'),
    ("kyoto/kyoto-pref-cats", '<div class="content clearfix"><h2>センター名：ししまる（検討中）</h2><table class="info"><tr><th>性別</th><td>オス</td></tr><tr><th>年齢</th><td>3歳</td></tr></table></div>'),
    ("aichi/aichi-pref-cats", "<table><tr><th>写真<th>特徴</tr><tr><td><img src=\"p/1.jpg\"></td><td>管理No.１２３ 推定2歳 キジトラ メス 譲渡済み</td></tr></table>"),
    ("okinawa/okinawa-pref-cats", '<a href="/x">x</a><a href="https://o.jp/animals/transfer_view/77"><div class="title"><p>推進棟 ミケ ※環境調査中</p><span class="date">2025/1/2</span></div><img src="/m.png"></a>'),
    ("chiba/chiba-city-cats", "<h4>その他</h4><h4>25000012（タマ）</h4><p><img src='t.jpg'></p><p>性別：オス<br>毛色：白<br>年齢：成猫<br>コメント：元気</p>"),
    ("kochi/kochi-pref", '<div class="tab-animal-card"><table><tr><th>管理番号</th><td>R7/A_1</td></tr><tr><th>仮名</th><td>ポチ</td></tr><tr><th>種類</th><td>雑種犬</td></tr><tr><th>性別</th><td>雄</td></tr></table></div>'),
    ("fukui/fukui-pref-cats", '<article class="animal-item"><h2>管理番号：HC25378(松岡)</h2><dl class="spec"><dt>性別</dt><dd>メス</dd></dl></article>'),
    ("miyagi/sendai-city-dogs", "<table><tr><td>D12345<td>雑種<td>去勢オス<td>5歳<td>中型<td>茶<td>ワクチン済</tr></table>"),
    ("kanagawa/yokohama-city-cats", '<h2>譲渡動物情報《猫》</h2><img alt="251の猫の写真" src="a/jotof2501.jpg"><h2>譲渡されました</h2><img alt="99の猫の写真" src="b.jpg">'),
    ("fukuoka/fukuoka-pref-dogs", '<a href="/animals/center-detail/ab-12"><dl><dt>性別</dt><dd>オス</dd></dl><dl><dt>大きさ</dt><dd>小型 (2.5kg)</dd></dl></a>'),
    ("hiroshima/hiroshima-city", "<h3>犬</h3><h4>No.7-1-23（ハナ）</h4><p>雌 ３歳</p>"),
    ("okayama/okayama-pref", "<table><tr><th>収容日<th>管理番号</tr><tr><td>2025/1/5</td><td>K-7</td><td>雑種<td>3歳<td>茶<td>メス<td>中<td>元気<td>倉敷<td><img src='/noimage.png'></tr></table>"),
    ("osaka/osaka-city-cats", "<div class='sub_h3_box'><h3>識別番号／C123（仮名：ムギ）</h3></div><div class='mol_imageblock'><img src='a.jpg'><p>・種類／雑種<br>・毛色／キジ白<br>・性別／メス（避妊済）<br>・体格/小</p></div>"),
    ("toyama/toyama-pref-cats", "<div class='col2L'><a href='/x'><img src='c.jpg'>No.7002<br>アイ（オス）</a></div><div class='col2R'><p>No.7003<br>ゆう（メス）</p></div>"),
    ("gunma/gunma-pref-dogs", "<h4><a href='d'>ポチ</a>（管理番号2025-F126）</h4><p>雑種、8才齢（推定）、オス、白茶、中型（18.1キログラム）、去勢済み</p>"),
    ("chiba/chiba-pref-cats", "<div class='col2L'><p>【管理番号】ch-12</p><p>【収容場所】柏市</p><p>雑種 オス</p><p>【掲載期限】2025年2月1日</p><img src='no_gazou.gif'></div>"),
    ("osaka/sakai-city-cats", '<img src="/logo2.jpg"><div class="img-area"><img src="/i/R7_1.png"></div>'),
    ("nobody/unknown", "<tr><td>x</td></tr>"),
]


@pytest.fixture(scope="module")
def found(spark):
    pages = spark.createDataFrame([(f, h, "https://s.jp/d/i.html") for f, h in PAGES], "facility string, html string, url string")
    out = {}
    for r in extract.listings(pages, layouts.catalogue(spark)).orderBy("facility", "record_no").collect():
        out.setdefault(r["facility"], []).append(r)
    return out


def test_facilities(found):
    assert set(found) == {f for f, _ in PAGES if f != "nobody/unknown"}


@pytest.mark.parametrize("facility, want", [
    ("ishikawa/aigo-ishikawa", dict(external_id="12", name="紅蘭", breed="トイプードル", age_estimate="2歳", gender="female", color="茶", images=["https://s.jp/i/a.jpg"])),
    ("kyoto/kyoto-pref-cats", dict(external_id="kyoto_0", name="ししまる", gender="male", age_estimate="3歳", animal_type="cat", needs_review=True)),
    ("aichi/aichi-pref-cats", dict(external_id="aichi-123", gender="female", age_estimate="2歳", color="キジトラ", status="adopted", images=["https://s.jp/d/p/1.jpg"])),
    ("okinawa/okinawa-pref-cats", dict(external_id="77", name="ミケ", protection_date="2025/1/2", images=["https://s.jp/m.png"])),
    ("chiba/chiba-city-cats", dict(external_id="chiba-city-25000012", name="タマ", gender="male", color="白", age_estimate="成猫", personality="元気")),
    ("kochi/kochi-pref", dict(external_id="kochi-pref-r7-a-1", name="ポチ", gender="male", animal_type="dog")),
    ("fukui/fukui-pref-cats", dict(external_id="HC25378", gender="female")),
    ("miyagi/sendai-city-dogs", dict(external_id="sendai-city-D12345", breed="雑種", gender="male", age_estimate="5歳", size="medium", color="茶")),
    ("kanagawa/yokohama-city-cats", dict(external_id="yokohama-251", images=["https://s.jp/d/a/jotof2501.jpg"])),
    ("fukuoka/fukuoka-pref-dogs", dict(external_id="fukuoka-pref-ab-12", gender="male", size="small")),
    ("hiroshima/hiroshima-city", dict(external_id="hiroshima-city-7-1-23", name="ハナ", gender="female", age_estimate="3歳")),
    ("okayama/okayama-pref", dict(external_id="K-7", gender="female", size="medium", age_estimate="3歳", special_needs="倉敷", images=[])),
    ("osaka/osaka-city-cats", dict(external_id="C123", name="ムギ", breed="雑種", color="キジ白", gender="female", size="small")),
    ("toyama/toyama-pref-cats", dict(external_id="7002", name="アイ", gender="male", images=["https://s.jp/d/c.jpg"])),
    ("gunma/gunma-pref-dogs", dict(external_id="2025-F126", name="ポチ", gender="male", size="medium", age_estimate="8才齢（推定）", health_status="去勢済み")),
    ("chiba/chiba-pref-cats", dict(external_id="chiba-pref-ch-12", gender="male", deadline_date="2025-02-01", special_needs="柏市", images=[])),
    ("osaka/sakai-city-cats", dict(external_id="R7_1", images=["https://s.jp/i/R7_1.png"])),
])
def test_record(found, facility, want):
    got = found[facility][0].asDict()
    assert {k: got[k] for k in want} == want


def test_second_container_gets_a_fallback_id(found):
    a, b = found["ishikawa/aigo-ishikawa"]
    assert (b["external_id"], b["name"], b["gender"], b["needs_review"]) == ("1", "太郎", "male", True)


def test_catalogue_has_each_facility_once():
    names = [x.facility for x in layouts.CATALOGUE]
    assert len(names) == len(set(names))


def test_last_row_ends_before_the_foot_and_dates_are_iso(spark):
    foot = '</table><p>譲渡しました</p><img src="/foot.jpg">'
    pages = [
        ("aichi/aichi-pref-cats", '<table><tr><td><img src="1.jpg"></td><td>管理No.1 推定2歳 メス</td></tr><tr><td>\x01管理No.2 オス</td></tr>' + foot),
        ("chiba/chiba-pref-cats", "<div class='col2L'><p>【管理番号】ch-12</p><p>【掲載期限】2025年2月1日</p></div>"),
    ]
    rows = spark.createDataFrame([(f, h, "https://s.jp/d/i.html") for f, h in pages], "facility string, html string, url string")
    a, b, c = extract.listings(rows, layouts.catalogue(spark)).orderBy("facility", "record_no").collect()
    assert [(r.external_id, r.status, r.gender, r.listing_type) for r in (a, b)] == [
        ("aichi-1", "available", "female", "adoption"), ("aichi-2", "available", "male", "adoption"),
    ]
    assert [x.rsplit("/", 1)[1] for x in a.images] == ["1.jpg"] and not b.images
    assert (c.listing_type, c.deadline_date) == ("lost_pet", "2025-02-01")


def _read(spark, *pages):
    rows = spark.createDataFrame([(f, h, "https://s.jp/d/i.html") for f, h in pages], "facility string, html string, url string")
    return extract.listings(rows, layouts.catalogue(spark)).orderBy("facility", "record_no", "external_id").collect()


FOOT = '<div class="foot"><p>譲渡しました</p><img src="/foot.jpg"><table><tr><td>問合せ</td></tr></table></div></body></html>'


def _names(rows):
    return [[x.rsplit("/", 1)[1] for x in r.images] for r in rows]


def test_a_record_ends_with_its_own_element(spark):
    card = '<div class="tab-animal-card"><div class="in"><div></div><img src="{0}.jpg"></div><table><tr><th>管理番号</th><td>{0}</td></tr><tr><th>性別</th><td>オス</td></tr></table></div>'
    rows = _read(spark, ("kochi/kochi-pref", "<html><body><div>案内<img src='h.jpg'></div><div id=m>" + card.format("A1") + "<p>間</p>" + card.format("A2") + "</div>" + FOOT))
    assert [(r.external_id, r.status) for r in rows] == [("kochi-pref-a1", "available"), ("kochi-pref-a2", "available")]
    assert _names(rows) == [["A1.jpg"], ["A2.jpg"]]


def test_a_heading_record_ends_with_the_element_around_it(spark):
    page = "<body><div id=m><h3>1D001 (ポチくん)</h3><p>種類：雑種<br>性別：オス</p><div><img src='a.jpg'></div><h3>1D002 (ハナ)</h3><p>性別：メス</p></div>"
    rows = _read(spark, ("okayama/okayama-city-dogs", page + FOOT))
    assert [(r.external_id, r.name, r.gender, r.status) for r in rows] == [("1D001", "ポチ", "male", "available"), ("1D002", "ハナ", "female", "available")]
    assert _names(rows) == [["a.jpg"], []]


def test_a_link_record(spark):
    link = '<li><a href="/animals/center-detail/{0}"><img src="{0}.png"><dl><dt>性別</dt><dd>オス</dd></dl></a></li>'
    rows = _read(spark, ("fukuoka/fukuoka-pref-cats", "<ul>" + link.format("a1") + link.format("b2") + "</ul>" + FOOT))
    assert [r.status for r in rows] == ["available"] * 2 and _names(rows) == [["a1.png"], ["b2.png"]]


def test_an_element_that_is_never_closed(spark):
    rows = _read(spark, ("kochi/kochi-pref", '<div class="tab-animal-card"><table><tr><th>管理番号</th><td>Z9</td></tr></table><p>x'))
    assert [r.external_id for r in rows] == ["kochi-pref-z9"]


def test_picture_before_the_table_and_number_of_a_record_without_id(spark):
    one = '<figure class="img-item"><img src="{0}.jpg"></figure><div class="wysiwyg"><table><caption><p>{1}</p></caption><thead><tr><th>種類</th></tr><tr><td>雑種</td><td>白</td><td>{2}</td><td>2歳</td><td>小</td></tr></thead></table></div>'
    page = one.format("p1", "動物番号：K1", "オス") + one.format("p2", "（番号なし）", "メス") + '<div class="wysiwyg"><table><tr><td>雑種</td><td>黒</td></tr></table></div>'
    rows = _read(spark, ("ishikawa/kanazawa-city-cats", "<img src='top.jpg'>" + page + FOOT))[:3]
    assert [(r.external_id, r.gender, r.needs_review) for r in rows] == [("K1", "male", False), ("kanazawa_2", "female", True), ("kanazawa_3", "unknown", True)]
    assert _names(rows) == [["p1.jpg"], ["p2.jpg"], []]


def test_many_animals_in_an_entry(spark):
    entry = '<article class="animal-item"><h2>管理番号：{}(松岡)</h2><dl class="spec"><dt>性別</dt><dd>{}</dd></dl></article>'
    rows = _read(spark, ("fukui/fukui-pref-cats", entry.format("HC25378.25379", "オス：1匹、メス：1匹") + entry.format("HC1", "オス：1匹、メス：2匹") + entry.format("HC2", "メス") + FOOT))
    assert [(r.external_id, r.gender) for r in rows] == [
        ("25379", "female"), ("HC25378", "male"), ("HC1-1", "male"), ("HC1-2", "female"), ("HC1-3", "female"), ("HC2", "female"),
    ]


def test_labels_above_their_values(spark):
    table = ('<table class="f_a3"><tr><td class="photo" rowspan="4"><a><img src="{0}.jpg"></a></td><th>番号</th></tr><tr><td>{0}</td></tr><tr><th>推定生年月日</th><th>性別</th></tr>'
             '<tr><td>令和５年４月</td><td>{1}</td></tr><tr><th colspan="2">その他の情報</th></tr><tr><td colspan="2">人懐こい</td></tr></table>')
    rows = _read(spark, ("tokushima/tokushima-pref-dogs", "<ul class='news'>" + table.format("Ｔ-１".replace("Ｔ", "T"), "オス（去勢）") + table.format("T-2", "メス") + "</ul>" + FOOT))
    assert [(r.external_id, r.gender, r.age_estimate, r.special_needs) for r in rows] == [
        ("tokushima-pref-t-1", "male", "令和5年4月", "人懐こい"), ("tokushima-pref-t-2", "female", "令和5年4月", "人懐こい"),
    ]
    assert _names(rows) == [["T-１.jpg"], ["T-2.jpg"]]


def test_records_side_by_side(spark):
    pair = lambda k, a, b: f"<tr><th>{k}</th><td>{a}</td><th>{k}</th><td>{b}</td></tr>"
    table = ("<table>" + pair("管理番号", "R7-39（名前：ショウ）", "R7-43（イチロー）") + pair("写真", '<img src="/uploaded/image/1.jpg" alt="39の写真">', '<img src="/uploaded/image/2.jpg" alt="43の写真">')
             + pair("毛色", "茶", "白黒") + pair("性別", "オス", "メス") + pair("体格", "中型 12.5kg", "8kg") + "<tr><th>備考</th><td>なし</td></tr></table>")
    rows = _read(spark, ("ibaraki/mito-city-dogs", "<table><tr><td>案内</td></tr></table>" + table + FOOT))
    assert [(r.external_id, r.name, r.color, r.gender) for r in rows] == [("mito-city-dog-39", "ショウ", "茶", "male"), ("mito-city-dog-43", "イチロー", "白黒", "female")]
    assert _names(rows) == [["1.jpg"], ["2.jpg"]]


def test_records_in_columns(spark):
    table = ('<table class="datatable"><caption>{0}</caption><tr><th>写真</th><td><img src="/i/{1}1.jpg"></td><td><img src="/i/{1}2.JPG"></td></tr><tr><th>年齢</th><td>2024年4月生</td><td>2023年1月生</td></tr>'
             "<tr><th>毛色</th><td colspan=2>茶トラ</td></tr><tr><th>性別</th><td>オス（去勢）</td><td>メス</td></tr></table>")
    rows = _read(spark, ("ehime/ehime-pref", "<table><tr><td>x</td></tr></table>" + table.format("譲渡猫", "c") + table.format("", "d") + table.format("譲渡犬", "e") + FOOT))
    assert [(r.external_id, r.animal_type, r.age_estimate, r.color, r.gender) for r in rows] == [
        (f"ehime-pref-{kind}-{n}{i}", kind, age, "茶トラ", sex)
        for n, kind in (("c", "cat"), ("d", "cat"), ("e", "dog")) for i, age, sex in ((1, "2024年4月生", "male"), (2, "2023年1月生", "female"))
    ]


def test_sections_by_species_and_names_that_are_none(spark):
    one = '<div class="img-area-l"><p><img src="{0}.jpg"><br><span>{0}</span></p><p>{1}：雑種性別：メス推定年齢：3歳体重：4.2kg性格・特徴：おだやか写真撮影日：1月</p></div>'
    none = '<div class="img-area-l"><span>現在譲渡できる猫はいません</span></div>'
    page = "<div><h3>譲渡犬紹介</h3></div>" + one.format("マル", "犬種") + one.format("クロ", "犬種") + "<div><h3>譲渡猫紹介</h3></div>" + one.format("ミケ", "猫種") + none
    rows = _read(spark, ("okinawa/naha-city", page + FOOT))
    assert [(r.external_id, r.animal_type, r.breed, r.gender, r.age_estimate, r.size, r.personality, r.status) for r in rows] == [
        (n, k, "雑種", "female", "3歳", "4.2kg", "おだやか", "available") for n, k in (("マル", "dog"), ("クロ", "dog"), ("ミケ", "cat"))
    ]


def test_fallback_by_name(spark):
    page = '<div><h3>トップページ</h3><h3>ゆきお</h3><p><img src="a.jpg" alt="25長YD02-ゆきお"></p><h3>うめ</h3><p><img src="b.jpg" alt="24芝YD006　うめ"></p><h3>Kuro</h3><p><img src="c.jpg"></p></div>'
    rows = _read(spark, ("niigata/niigata-pref-dogs", page + FOOT))
    assert [(r.external_id, r.name) for r in rows] == [("niigata-pref-dog-ゆきお", "ゆきお"), ("niigata-pref-24芝YD006", "うめ"), ("niigata-pref-dog-kuro", "Kuro")]
    assert _names(rows) == [["a.jpg"], ["b.jpg"], ["c.jpg"]]


def test_ids_by_branch_number_and_name(spark):
    rows = _read(
        spark,
        ("aichi/aichi-pref-cats", "<!-- BRANCH: honjo --><table><tr><td>管理No.1 メス</td></tr></table><!-- BRANCH: owari --><table><tr><td>管理No.2 オス</td></tr></table>"),
        ("hyogo/kobe-city", "<table><tr><th>名前</th></tr><tr><td>ミケ</td><td>雑種</td><td>メス</td></tr><tr><td>空</td></tr></table>"),
        ("kanagawa/kanagawa-pref-cats", '<div class="is-one-quarter-desktop"><table><tr><th>仮名</th><td>ハナ</td></tr></table></div><div class="is-one-quarter-desktop"><table><tr><th>性別</th><td>オス</td></tr></table></div>'),
        ("tochigi/tochigi-pref-cats", "<table><tr><td>番号：１２</td></tr><tr><td>オス</td></tr></table>"),
    )
    assert [r.external_id for r in rows] == ["aichi-honjo-1", "aichi-owari-2", "kobe-2", "kanagawa-ハナ", "kanagawa-unknown-1", "A-12"]
