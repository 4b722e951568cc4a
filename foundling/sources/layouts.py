"""Page layouts as data: how a facility's page is cut into records and where
each field stands.  One row per facility; `operators.extract` reads them.

A new facility is a new row, not new code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.dictionaries import LABELS
from ..functions.text import alternation

# fixed values: fields a layout can fill
FIELDS = (
    "name", "breed", "age_estimate", "gender", "color", "size", "health_status", "personality", "special_needs",
    "protection_date", "deadline_date",
)
RULE = "struct<kind:string,arg:string,run_on:string>"
SCHEMA = (
    "facility string, mark string, area string, shape string, id_kind string, id_pattern string, id_prefix string, id_required boolean, id_slug boolean, "
    "row_record boolean, up int, picture string, picture_alt boolean, spread string, section string, skip string, many boolean, fallback string, min_cells int, "
    f"species string, listing_type string, iso_dates boolean, rules struct<{','.join(f'{f}:{RULE}' for f in FIELDS)}>"
)


def tag(names: str) -> str:
    """Records that each start with one of the tags (``h3|h4``)."""
    return rf"(?i)<(?:{names})[\s>]"


def classed(*names: str) -> str:
    """Records that start with an element of one of the classes."""
    return rf"(?i)<[a-z0-9]+[^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?(?:{'|'.join(names)})[\s\"']"


def link(target: str) -> str:
    """Records that are links to a matching target."""
    return rf"(?i)<a\s[^>]*href\s*=\s*[\"'][^\"']*{target}"


@dataclass(frozen=True)
class Layout:
    """``shape`` tells how labels and values stand in a record: ``pairs``
    (th/td), ``rows`` (two td), ``list`` (dt/dd), ``lines`` (``label：value``),
    ``run_on`` (labels inside running text) or ``none``.

    A record ends before the next one starts, and where its nesting says: ``up``
    0 ends it with the element it starts with (the default), 1 with the element
    around its start (headings), 2 with the one around that, -1 nowhere.

    ``picture`` says where its picture stands: ``inside``, or ``before`` or
    ``after`` it, which takes the nearest one between two records.  ``spread``
    makes several records of a table: its ``columns``, or its ``pairs`` side by
    side.  ``section`` is a pattern whose last match so far, on the page, is put
    before the record's text.  A record whose name matches ``skip`` is none.
    With ``many`` an entry with several ids or numbered genders is one record each.

    A record without a readable id gets ``fallback``, with its number on the
    page (``{k}`` from 0, ``{n}`` from 1), ``{name}``, or the name in lower case
    with dashes for blanks (``{slug}``) in it; with ``id_required`` and no
    ``fallback`` it is a header row or the like, and none, as is one with fewer
    than ``min_cells`` cells.  ``id_prefix`` may hold ``{type}`` and ``{section}-``.
    With ``iso_dates`` the dates that can be read become year-month-day, others
    stay as written.

    ``rules`` map a field to ``label:<words>``, ``cell:<number>``,
    ``text:<pattern with a group>`` or ``html:<pattern with a group>``.
    """

    facility: str
    record_start: str
    shape: str = "none"
    id_pattern: str | None = None
    id_prefix: str = ""
    id_required: bool = True
    id_slug: bool = False
    species: str | None = None
    listing_type: str = "adoption"
    iso_dates: bool = False
    rules: Mapping[str, str] = field(default_factory=dict)
    area: tuple[str, str] | None = None
    up: int | None = None
    picture: str = "inside"
    picture_alt: bool = False
    spread: str | None = None
    section: str | None = None
    skip: str | None = None
    many: bool = False
    fallback: str | None = None
    min_cells: int = 0


def _pair(base: str, kinds: Mapping[str, Mapping], **common) -> list[Layout]:
    """The same layout for cats and dogs with what differs."""
    return [
        Layout(facility=f"{base}-{kind}", species=kind[:-1], **{**common, **own, "rules": {**common.get("rules", {}), **own.get("rules", {})}})
        for kind, own in kinds.items()
    ]


# fixed values: labels, number formats and column positions of the facilities' pages
_AGE = r"text:(?:推定)?([0-9０-９.]+(?:歳|才|[かヶケ]月))"
CATALOGUE: list[Layout] = [
    # running text with labels
    Layout(
        "ishikawa/aigo-ishikawa", classed("data_box", "animal-card", "pet-item", "animal-info", "cat-item"), "run_on",
        r"(?i)(?:No\.?\s*|ID[\s:]*|管理番号[\s:]*)([0-9]+)", id_required=False,
        rules={"name": "label:仮名|名前", "breed": "label:種類|品種", "age_estimate": "label:推定年齢|年齢", "gender": "label:性別", "color": "label:毛色"},
    ),
    # a table per record
    Layout(
        "ishikawa/kanazawa-city-cats", tag("table"), id_pattern=r"動物番号[：:]\s*([0-9A-Za-z_]+)", species="cat", picture="before", fallback="kanazawa_{n}",
        rules={"breed": "cell:0", "color": "cell:1", "gender": "cell:2", "age_estimate": "cell:3", "size": "cell:4", "name": "text:[『「]([^』」]+)[』」]"},
    ),
    *_pair(
        "gunma/maebashi-city",
        {"cats": {"id_pattern": "(C[0-9]{4}-[0-9]+)", "rules": {"color": "cell:3", "gender": "cell:4"}},
         "dogs": {"id_pattern": "(D[0-9]{4}-[0-9]+)", "rules": {"gender": "cell:3", "color": "cell:4"}}},
        record_start=tag("table"),
        rules={"name": "cell:0", "breed": "cell:1", "health_status": "cell:2", "age_estimate": "cell:5", "personality": "cell:6"},
    ),
    *_pair("tochigi/tochigi-pref", {"cats": {"id_prefix": "A-"}, "dogs": {}}, record_start=tag("table"), id_pattern=r"番号[：:]\s*([0-9０-９]+)", rules={"gender": "text:(オス|メス)"}),
    # a table row per record
    *_pair(
        "aichi/aichi-pref",
        {"cats": {"rules": {"color": "text:(雑種|キジトラ|サビ|三毛|白|黒|茶トラ|グレー)"}}, "dogs": {"rules": {"breed": "text:(雑種|柴犬|チワワ|プードル|ミックス)"}}},
        record_start=tag("tr"), id_pattern=r"管理No\.?\s*([0-9０-９]+)", id_prefix="aichi-{section}-", section=r"<!-- BRANCH: ([0-9A-Za-z_]+) -->",
        rules={"gender": "text:(オス|雄|メス|雌)", "age_estimate": "text:推定?([0-9０-９]+[歳才])"},
    ),
    Layout(
        "hokkaido/sapporo-city-cats", tag("tr"), id_pattern=r"^\s*([0-9A-Za-z][0-9A-Za-z－-]*)\s", species="cat",
        rules={"gender": "cell:1", "color": "cell:2", "age_estimate": "cell:3"},
    ),
    Layout("hyogo/kobe-city", tag("tr"), id_prefix="kobe-", fallback="{n}", min_cells=3, rules={"name": "cell:0", "breed": "cell:1", "gender": "cell:2"}),
    Layout(
        "fukuoka/kitakyushu-city-cats", tag("tr"), id_pattern="([A-Z][0-9]{5})", id_prefix="kitakyushu-city-", species="cat",
        rules={"name": "text:[A-Z][0-9]{5}[^（(]*[（(](.+?)[）)]", "gender": "cell:1", "color": "cell:2", "age_estimate": "cell:3"},
    ),
    Layout(
        "fukuoka/kitakyushu-city-dogs", tag("tr"), id_pattern="([A-Z][0-9]{5})", id_prefix="kitakyushu-city-", species="dog",
        rules={"name": "text:[A-Z][0-9]{5}[^（(]*[（(](.+?)[）)]", "breed": "cell:1", "gender": "cell:2", "color": "cell:3", "age_estimate": "cell:4"},
    ),
    *_pair(
        "miyagi/sendai-city",
        {"cats": {"id_pattern": "(C[0-9]{5})", "rules": {"size": "cell:3", "color": "cell:4", "health_status": "cell:5"}},
         "dogs": {"id_pattern": "(D[0-9]{5})", "rules": {"age_estimate": "cell:3", "size": "cell:4", "color": "cell:5", "health_status": "cell:6"}}},
        record_start=tag("tr"), id_prefix="sendai-city-", rules={"breed": "cell:1", "gender": "cell:2"},
    ),
    Layout("saitama/saitama-city-cats", tag("tr"), id_prefix="saitama-city-", id_required=False, species="cat", rules={"name": "cell:0", "gender": "text:((?:去勢)?オス|(?:避妊)?メス)"}),
    Layout(
        "saitama/saitama-pref-cats", tag("table"), "rows", r"管理番号\s*([0-9A-Za-z-]{6,})", species="cat", listing_type="lost_pet",
        rules={"protection_date": "label:収容日", "color": "label:特徴|毛色", "special_needs": "label:収容場所|市"},
    ),
    # th/td pairs
    *_pair(
        "kyoto/kyoto-pref", {"cats": {"id_prefix": "kyoto_"}, "dogs": {"id_prefix": "kyoto-dog-"}},
        record_start=r"(?i)<div[^>]*\sclass\s*=\s*[\"']content clearfix", shape="pairs", id_required=False,
        rules={"name": r"html:(?is)<h2[^>]*>(?:センター名[：:])?\s*([^<（(]+)", "gender": "label:性別", "age_estimate": "label:年齢", "color": "label:毛色"},
    ),
    *_pair(
        "kanagawa/kanagawa-pref", {"cats": {"record_start": classed("is-one-quarter-desktop")}, "dogs": {"record_start": classed("card", "animal-card")}},
        record_start="", shape="pairs", id_prefix="kanagawa-", fallback="{name}",
        rules={"name": "label:仮名", "gender": "label:性別", "size": "label:大きさ|体格|サイズ", "breed": "label:種類", "color": "label:毛色", "age_estimate": "label:年齢", "protection_date": "label:収容時期"},
    ),
    Layout(
        "osaka/osaka-pref-cats", tag("table"), "pairs", r"管理番号\s*(\S+)", up=1, species="cat",
        rules={"color": "label:毛色", "gender": "label:性別", "age_estimate": "label:推定年齢", "size": "label:体重", "personality": "label:アピールポイント", "protection_date": "label:撮影年月日"},
    ),
    Layout(
        "kochi/kochi-pref", classed("tab-animal-card"), "pairs", r"管理番号\s*(\S+)", "kochi-pref-", id_slug=True,
        rules={"name": "label:仮名", "breed": "label:種類", "gender": "label:性別"},
    ),
    # labels above their values
    *_pair(
        "tokushima/tokushima-pref", {"cats": {}, "dogs": {}}, record_start=classed("f_a3"), shape="stacked", id_pattern=r"番号\s*([0-9０-９A-Za-z-]+)", id_prefix="tokushima-pref-", id_slug=True,
        rules={"gender": "label:性別", "age_estimate": "label:推定生年月日", "special_needs": "label:その他の情報", "protection_date": "label:譲渡可能日"},
    ),
    # animals side by side in a table of th/td pairs
    Layout(
        "ibaraki/mito-city-dogs", tag("table"), "pairs", r"管理番号\s*R?[0-9]+-([0-9]+)\s*[（(]", "mito-city-dog-", species="dog", spread="pairs", picture_alt=True,
        rules={"name": r"text:[（(](?:名前[:：\s]*)?(.+?)[）)]", "color": "label:毛色", "gender": "label:性別", "size": "label:体格", "age_estimate": "label:年齢", "health_status": "label:ワクチン", "personality": "label:特徴"},
    ),
    # a table whose columns are animals
    Layout(
        "ehime/ehime-pref", classed("datatable"), id_pattern=r"html:(?i)<img[^>]*\ssrc\s*=\s*[\"'](?:[^\"']*/)?([^/\"']+?)(?:\.(?:jpg|png|jpeg))?[\"']", id_prefix="ehime-pref-{type}-", spread="columns",
        section=r"(?is)<caption[^>]*>[^猫犬]*?([猫犬])", rules={"age_estimate": "cell:1", "color": "cell:2", "gender": "cell:3"},
    ),
    # sections by species
    Layout(
        "okinawa/naha-city", classed("img-area-l"), section="譲渡([犬猫])紹介", id_pattern=r"html:(?is)<span[^>]*>\s*([^<]+?)\s*</span>", skip="譲渡できる|いません",
        rules={"name": r"html:(?is)<span[^>]*>\s*([^<]+?)\s*</span>", "breed": "text:(?:犬種|猫種)：([^性推体]+)", "gender": "text:性別：([^推体性写]+)", "age_estimate": "text:推定年齢：([^体性写]+)",
               "size": "text:体重：?([^性写]+?kg)", "personality": "text:性格・特徴：([^写]+?)(?:フィラリア|写真撮影日)", "health_status": "text:(フィラリア[^。写]+)"},
    ),
    Layout(
        "shizuoka/hamamatsu-city-dogs", r"(?i)<h1[\s>]", "rows", id_prefix="hamamatsu-city-", fallback="{slug}", species="dog",
        rules={"name": r"html:(?is)<h1[^>]*>\s*([^<]+)", "breed": "label:犬　?種", "gender": "label:性　?別", "age_estimate": "label:年　?齢", "size": "label:体　?格", "special_needs": "label:特記事項"},
    ),
    # dt/dd pairs
    *_pair("fukui/fukui-pref", {"cats": {}, "dogs": {}}, record_start=classed("animal-item"), shape="list", id_pattern=r"管理番号[：:]\s*([A-Z0-9.]+)", many=True, rules={"gender": "label:性別"}),
    Layout("tokyo/tokyo-metro-cats", classed("topMainBox"), "list", r"([0-9]{2,}-?[0-9]+)", species="cat", listing_type="lost_pet", iso_dates=True, rules={"protection_date": "label:収容日", "deadline_date": "label:収容期限"}),
    *_pair(
        "fukuoka/fukuoka-pref", {"cats": {}, "dogs": {}}, record_start=link("/animals/center-detail/"), shape="list", id_pattern=r"html:/animals/center-detail/([a-f0-9-]+)",
        id_prefix="fukuoka-pref-",
        rules={"gender": "label:性別", "protection_date": "label:登録日", "age_estimate": "label:推定年齢", "size": "label:大きさ|体重"},
    ),
    Layout(
        "okayama/okayama-pref", tag("tr"), id_pattern=r"html:(?is)^<tr[^>]*>\s*<td[^>]*>[^<]*</td>\s*<td[^>]*>\s*([^<\s]+)",
        rules={"protection_date": "cell:0", "breed": "cell:2", "age_estimate": "cell:3", "color": "cell:4", "gender": "cell:5", "size": "cell:6",
               "personality": "cell:7", "special_needs": "cell:8"},
    ),
    # blocks and cards
    *_pair(
        "chiba/chiba-pref", {"cats": {"id_prefix": "chiba-pref-"}, "dogs": {"id_prefix": "chiba-pref-dog-"}}, record_start=classed("col2L"), shape="lines", listing_type="lost_pet", iso_dates=True,
        id_pattern=r"【管理番号】\s*([^\s【]+)", rules={"deadline_date": "label:掲載期限", "special_needs": "label:収容場所", "gender": "text:(オス|メス)"},
    ),
    *_pair(
        "toyama/toyama-pref", {"cats": {}, "dogs": {}}, record_start=classed("col2L", "col2R"), id_pattern=r"No\.([0-9]+)",
        rules={"name": r"html:(?is)No\.[0-9]+\s*(?:<[^>]+>\s*)*([^<（\s]+)", "gender": "text:（(オス|メス)）"},
    ),
    Layout(
        "hyogo/hyogo-pref-cats", classed("item-gallery-item"), id_prefix="hyogo-", id_required=False,
        rules={"breed": r"text:([^、\s]*(?:雑種|純血)[^、\s]*)", "gender": "text:(オス|おす|雄|メス|めす|雌)", "age_estimate": r"text:([^、\s]*(?:歳|齢)[^、\s]*)",
               "health_status": "text:((?:去勢|避妊)済み)"},
    ),
    Layout(
        "gunma/gunma-pref-cats", r"(?i)<p[^>]*>\s*ニックネーム：", up=1, id_pattern=r"管理番号([^）\s]+)", species="cat",
        rules={"name": r"html:(?is)<a\s[^>]*>([^<]+)</a>"},
    ),
    Layout(
        "gunma/gunma-pref-dogs", tag("h4"), id_pattern=r"管理番号([^）\s]+)", species="dog",
        rules={"name": r"html:(?is)<a\s[^>]*>([^<]+)</a>", "age_estimate": "text:([0-9０-９]+才齢[^、]*)", "gender": "text:、(オス|メス)", "size": "text:(小型|中型|大型)",
               "health_status": "text:((?:去勢|避妊)済み)"},
    ),
    # headings with what follows
    *_pair(
        "okayama/okayama-city", {"cats": {"id_pattern": "(1C[0-9]+)"}, "dogs": {"id_pattern": "(1D[0-9]+)"}}, record_start=tag("h3"), shape="lines",
        rules={"name": r"text:\((.+?)(?:くん|ちゃん|君)?\)", "breed": "label:種類", "gender": "label:性別", "size": "label:体重", "age_estimate": "label:年齢",
               "health_status": "label:フィラリア"},
    ),
    Layout(
        "osaka/osaka-city-cats", tag("h3"), "lines", up=2, id_pattern=r"識別番号\s*[/／]\s*([^\s（]+)", species="cat",
        rules={"name": r"text:[（(]仮名[：:]\s*([^）)]+)[）)]", "breed": "label:種類", "color": "label:毛色", "gender": "label:性別", "age_estimate": "label:年齢",
               "size": "label:体格", "personality": "label:性格", "health_status": "label:その他"},
    ),
    *_pair(
        "niigata/niigata-city", {"cats": {"id_pattern": "([0-9]{4}k[0-9]+)"}, "dogs": {"id_pattern": "([0-9]{4}d[0-9]+)"}}, record_start=tag("li"),
        id_prefix="niigata-city-",
        rules={"name": r"html:(?is)<h2[^>]*>\s*([^<(]+)", "age_estimate": r"html:(?is)<h2[^>]*>[^<(]*\(([^)<]+)\)"},
    ),
    Layout(
        "niigata/niigata-pref-cats", tag("h3"), id_pattern=r"html:alt=\"[^\"]*?([0-9]{2}[^\s\"]+YC[0-9]{3,4})", id_prefix="niigata-pref-", id_required=False, species="cat",
        rules={"name": r"html:alt=\"([ぁ-んァ-ヶー]+)\""},
    ),
    Layout(
        "niigata/niigata-pref-dogs", tag("h3"), id_pattern=r"html:alt=\"[^\"]*?([0-9]{2}[^\s\"-]+YD[0-9]{3,4})", id_prefix="niigata-pref-", species="dog", fallback="dog-{slug}",
        skip="愛護センター|トップページ|譲渡に関すること|飼い主募集", rules={"name": r"html:(?is)<h3[^>]*>(?:\s|<[^>]+>)*([^<]+)"},
    ),
    Layout(
        "hiroshima/hiroshima-city", tag("h3|h4"), id_pattern=r"(?:No\.)?([67]-[0-9]+-[0-9]+)[（(]", id_prefix="hiroshima-city-",
        rules={"name": r"text:[67]-[0-9]+-[0-9]+[（(](.+?)[)）]", "gender": "text:(メス|雌|オス|雄)", "age_estimate": _AGE},
    ),
    *_pair(
        "hiroshima/hiroshima-pref", {"cats": {"id_pattern": "管理番号：(1HN[0-9]+)"}, "dogs": {"id_pattern": r"管理番号[：　\s]+(1HD[0-9]+|[0-9]{8,})"}},
        record_start=tag("h2"), id_prefix="hiroshima-pref-", rules={"gender": "text:(メス|雌|オス|雄)", "age_estimate": _AGE},
    ),
    *_pair(
        "chiba/chiba-city",
        {"cats": {"id_pattern": "([0-9]{8})[（(]", "id_prefix": "chiba-city-", "rules": {"name": "text:[0-9]{8}[（(](.+?)[）)]"}},
         "dogs": {"id_pattern": "([0-9]{8,})", "rules": {"name": "text:[0-9]{8,}[^（(]*[（(](.+?)[）)]", "breed": "label:種類"}}},
        record_start=tag("h4"), shape="lines", rules={"gender": "label:性別", "color": "label:毛色", "age_estimate": "label:年齢", "personality": "label:コメント"},
    ),
    Layout(
        "hokkaido/hokkaido-pref", tag("h3|h4"), id_prefix="hokkaido-pref-", id_required=False,
        rules={"name": r"text:（仮名）(.+?)（雑種", "breed": "text:（(雑種)", "color": r"text:（雑種(.+?)\s+(?:オス|メス)", "gender": r"text:（雑種.+?\s+(オス|メス)", "age_estimate": r"text:(?:オス|メス)\s+(.+?)）"},
    ),
    *_pair(
        "miyagi/miyagi-pref", {"cats": {"record_start": tag("h4"), "id_pattern": "ID:([0-9]+)【", "rules": {"name": "text:ID:[0-9]+【(.+?)】"}},
                               "dogs": {"record_start": tag("h3"), "id_pattern": r"ID:([0-9]+)[　\s]", "rules": {"name": r"text:ID:[0-9]+[　\s]+(\S+)"}}},
        record_start="", id_prefix="miyagi-pref-", rules={"gender": "text:(オス|去勢|メス|不妊)", "age_estimate": "text:推定([0-9]+歳)"},
    ),
    # links
    *_pair(
        "okinawa/okinawa-pref", {"cats": {}, "dogs": {}}, record_start=link("/animals/transfer_view/[0-9]"), id_pattern=r"html:/animals/transfer_view/([0-9]+)",
        rules={"name": r"html:(?is)class=\"title\".*?<p[^>]*>(?:推進棟\s*)?([^<※]+)", "special_needs": "text:※(.+)$", "protection_date": r"html:(?is)class=\"date\"[^>]*>([^<]+)"},
    ),
    *_pair(
        "fukuoka/fukuoka-city", {"cats": {"id_pattern": "c([0-9]+)【"}, "dogs": {"id_pattern": "d([0-9]+)【"}}, record_start=tag("a"), id_prefix="fukuoka-city-",
        rules={"name": r"text:仮名[：:]\s*([^\s　】]+)", "gender": "text:((?:去勢|不妊)?(?:オス|メス|雄|雌))", "age_estimate": "text:】\\s*([0-9]+(?:歳|か月|ヶ月|才))"},
    ),
    # images
    *_pair(
        "osaka/sakai-city", {"cats": {}, "dogs": {}}, record_start=tag("img"), area=(r"class=\"img-area", "(?:</body>|$)"),
        id_pattern=r"html:(?i)src\s*=\s*[\"'](?:[^\"']*/)?([^/\"']+)\.[a-z]+[\"']",
    ),
    *_pair(
        "kanagawa/yokohama-city",
        {"cats": {"id_pattern": "html:([0-9]+)の猫の写真", "area": ("譲渡動物情報《猫》", "(?:譲渡されました|$)")},
         "dogs": {"id_pattern": "html:([0-9]+)の犬の写真", "area": ("譲渡動物情報《犬》", "(?:譲渡されました|$)")}},
        record_start=tag("img"), id_prefix="yokohama-",
    ),
]


def _row(x: Layout) -> tuple:
    def rule(text: str | None):
        if text is None:
            return None
        kind, arg = text.split(":", 1)
        return kind, arg, rf"(?:{arg})\s*[:：]?\s*(.+?)\s*(?:{alternation(LABELS)}|$)"

    heading = any(x.record_start == tag(f) for f in ("h1", "h2", "h3", "h4", "h3|h4")) or x.record_start == r"(?i)<h1[\s>]"
    up = x.up if x.up is not None else 1 if heading else 0
    kind, pattern = ("html", x.id_pattern[5:]) if x.id_pattern and x.id_pattern.startswith("html:") else ("text", x.id_pattern)
    return (
        x.facility, f"({x.record_start})", f"(?s){x.area[0]}(.*?){x.area[1]}" if x.area else None, x.shape, kind, pattern, x.id_prefix,
        x.id_required and x.fallback is None, x.id_slug, x.record_start == tag("tr"), up, x.picture, x.picture_alt, x.spread, x.section, x.skip, x.many,
        x.fallback or "{k}", x.min_cells, x.species, x.listing_type, x.iso_dates, tuple(rule(x.rules.get(f)) for f in FIELDS),
    )


def catalogue(spark: SparkSession, layouts: Sequence[Layout] = tuple(CATALOGUE)) -> DataFrame:
    """The layouts as a (small) table."""
    return spark.createDataFrame([_row(x) for x in layouts], SCHEMA)
