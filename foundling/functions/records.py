"""Records out of short texts: one struct or array of structs per text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from . import classify, dates, dictionaries as D
from .text import ALL, alternation, any_of, bracketed, col, half_width, let, lines, repair


# ---- several animals in one entry -------------------------------------------------

def gender_counts(c: str | Column, words: Sequence[tuple[str, str]] = (("male", "オス"), ("female", "メス"))) -> Column:
    """``オス：1匹、メス：2匹`` as one gender per animal; a bare word counts once,
    nothing at all gives one unknown."""
    c = col(c)
    numbered = F.flatten(F.array(*[
        F.array_repeat(F.lit(g), F.coalesce(F.regexp_extract(c, f"{w}[：:]\\s*([0-9]+)\\s*匹", 1).try_cast("int"), F.lit(0)))
        for g, w in words
    ]))
    single = F.lit("unknown")
    for g, w in reversed(list(words)):
        single = F.when(c.contains(w), g).otherwise(single)
    return F.when(F.size(numbered) > 0, numbered).otherwise(F.array(single))


def id_list(c: str | Column, label: str = "管理番号") -> Column:
    """``管理番号：HC25378.25379(場所)`` as ids; later parts are kept as written."""
    found = F.regexp_extract(col(c), f"{label}[：:]\\s*([A-Za-z0-9.]+)", 1)
    return F.filter(F.split(found, r"\."), lambda x: x != "")


def zip_ids(ids: str | Column, genders: str | Column) -> Column:
    """Pair ids with genders by position.  With too few ids the last known base
    gets the position as suffix; with none the id stays null."""

    def paired(both: Column) -> Column:
        ids, genders = both["ids"], both["genders"]
        n = F.greatest(F.size(ids), F.size(genders))

        def record(i: Column) -> Column:
            own, base = F.get(ids, i), F.coalesce(F.get(ids, i), F.get(ids, F.lit(0)))
            key = F.when(F.size(ids) >= n, own).when(base.isNotNull(), F.concat(base, F.lit("-"), i + 1))
            gender = F.coalesce(F.get(genders, i), F.lit("unknown"))
            return F.struct((i + 1).alias("position"), key.alias("external_id"), gender.alias("gender"))

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), record))

    return let(F.struct(col(ids).alias("ids"), col(genders).alias("genders")), paired)


# ---- positional and delimited texts ---------------------------------------------

def delimited_attributes(c: str | Column, sep: str = "、") -> Column:
    """``雑種、8才齢（推定）、オス、白茶、中型（18.1キログラム）、去勢済み`` by kind of part.

    Each part has one kind; the first free part is the breed and the second the
    colour.
    """
    split = F.filter(F.transform(F.split(col(c), sep), lambda x: F.trim(x)), lambda x: x != "")

    def kind(p: Column) -> Column:
        return (
            F.when(p.contains("齢"), "age")
            .when(p.isin("オス", "メス"), "gender")
            .when(p.contains("キログラム"), "size")
            .when(p.contains("去勢") | p.contains("避妊"), "neutered")
            .otherwise("free")
        )

    def fields(parts: Column) -> Column:
        of = lambda k: F.filter(parts, lambda p: kind(p) == k)
        first = lambda k, i=0: F.get(of(k), F.lit(i))
        word, size_part, rest = first("gender"), first("size"), F.slice(of("free"), 3, ALL)
        return F.struct(
            first("free").alias("breed"),
            F.get(of("age"), F.size(of("age")) - 1).alias("age"),
            F.when(word == "オス", "male").when(word == "メス", "female").otherwise("unknown").alias("gender"),
            first("free", 1).alias("color"),
            classify.size(size_part).alias("size"),
            F.regexp_extract(size_part, r"([0-9.]+)キログラム", 1).try_cast("double").alias("weight_kg"),
            first("neutered").alias("neutered"),
            F.when(F.size(rest) > 0, F.array_join(rest, sep)).alias("personality"),
        )

    return let(split, fields)


def weight_kg(c: str | Column) -> Column:
    """Number before ``kg`` or ``キログラム``."""
    return F.regexp_extract(half_width(c), r"([0-9]+(?:\.[0-9]+)?)\s*(?:kg|ｋｇ|キロ)", 1).try_cast("double")


def weight_label(c: str | Column) -> Column:
    number = F.nullif(F.regexp_extract(half_width(c), r"([0-9]+(?:\.[0-9]+)?)\s*(?:kg|ｋｇ|キロ)", 1), F.lit(""))
    return F.coalesce(F.concat(number, F.lit("kg")), F.lit("不明"))


def outside_inside(c: str | Column) -> Column:
    """``X (Y)`` as the part before the bracket and the part in it."""
    return F.struct(
        F.nullif(F.trim(F.regexp_extract(col(c), r"^([^(（]+)", 1)), F.lit("")).alias("outside"),
        F.nullif(F.trim(bracketed(c)), F.lit("")).alias("inside"),
    )


ID_LINE = r"^([0-9][東中高西][-ー－]C[OO0]?[0-9]+)\s+(R[0-9]+\.[0-9]+\.[0-9]+)\s+(\S+)\s+(.*)$"


def positional_record(line: str | Column, pattern: str = ID_LINE) -> Column:
    """A space-separated row whose optional fields shift the later ones:
    id, era birth date, breed, colour, gender, [neutered], test, [test], notes.

    ``検査 未実施`` is one value written as two words.  Null when the row does
    not start with an id.
    """

    def fields(m: Column) -> Column:
        group = lambda i: F.regexp_extract(m, pattern, i)
        rest = F.split(F.replace(group(4), F.lit("検査 未実施"), F.lit("検査未実施")), r"\s+")

        def by_position(parts: Column) -> Column:
            at = lambda i: F.get(parts, i if isinstance(i, Column) else F.lit(i))
            neutered = F.coalesce(at(2).contains("去勢済") | at(2).contains("避妊済"), F.lit(False))
            first_test = F.when(neutered, 3).otherwise(2)
            felv, second = at(first_test), at(first_test + 1)
            has_second = F.coalesce(~second.startswith("・"), F.lit(False))
            notes_from = first_test + F.when(has_second, 2).otherwise(1)
            return F.struct(
                group(1).alias("external_id"), dates.era_date(group(2)).alias("birth_date"), group(3).alias("breed"),
                at(0).alias("color"), classify.gender(at(1)).alias("gender"), neutered.alias("neutered"),
                classify.test_result(felv).alias("felv"),
                classify.test_result(F.when(has_second, second).otherwise(felv)).alias("fiv"),
                F.array_join(F.slice(parts, notes_from + 1, F.size(parts) + 1), " ").alias("notes"),
            )

        return F.when(m != "", let(F.filter(rest, lambda x: x != ""), by_position))

    return let(F.regexp_extract(F.trim(col(line)), pattern, 0), fields)


# ---- lines of a card --------------------------------------------------------------

def card_lines(c: str | Column, id_pattern: str = r"No\.([0-9]+)", male: str = "オス", female: str = "メス") -> Column:
    """A card's lines: a number is the id, ``name（gender）`` gives both, a bare
    gender gives the gender, the first other line is the name."""
    words = f"{male}|{female}"
    whole = f"^(.+?)（({words})）$"
    part = f"（({words})）"
    start = F.struct(
        F.lit(None).cast("string").alias("external_id"), F.lit(None).cast("string").alias("name"), F.lit("unknown").alias("gender")
    )
    of = lambda word: F.when(word == male, "male").otherwise("female")

    def step(acc: Column, line: Column) -> Column:
        number = F.regexp_extract(line, id_pattern, 1)
        g_whole, g_part = F.regexp_extract(line, whole, 2), F.regexp_extract(line, part, 1)
        make = lambda i, n, g: F.struct(i.alias("external_id"), n.alias("name"), g.alias("gender"))
        return (
            F.when(number != "", make(number, acc["name"], acc["gender"]))
            .when(g_whole != "", make(acc["external_id"], F.regexp_extract(line, whole, 1), of(g_whole)))
            .when(g_part != "", make(acc["external_id"], F.trim(F.regexp_replace(line, part, "")), of(g_part)))
            .when(acc["name"].isNull(), make(acc["external_id"], line, acc["gender"]))
            .otherwise(acc)
        )

    return F.aggregate(lines(c), start, step)


def next_line_flag(c: str | Column, pattern: str, phrases: Sequence[str] = tuple(D.NEGOTIATION_PHRASES)) -> Column:
    """Lines matching ``pattern`` with a flag: the phrase is in the line after."""

    def flagged(rows: Column) -> Column:
        following = F.concat(F.slice(rows, 2, F.size(rows)), F.array(F.lit(None).cast("string")))
        pairs = F.zip_with(rows, following, lambda x, y: F.struct(x.alias("line"), any_of(y, phrases).alias("flag")))
        numbered = F.transform(pairs, lambda p, i: F.struct((i + 1).alias("line_no"), p["line"].alias("line"), p["flag"].alias("flag")))
        return F.filter(numbered, lambda x: x["line"].rlike(pattern))

    return let(F.split(col(c), r"\r?\n"), flagged)


def segments(c: str | Column, id_pattern: str) -> Column:
    """Text cut at its id lines: ``array<struct<segment_no,id,body>>``; what comes
    before the first id line is no record."""
    mark = "\x01"
    cut = F.split(F.regexp_replace(col(c), f"(?m)^({id_pattern})", mark + "$1"), mark)
    pieces = F.slice(cut, 2, ALL)
    return F.transform(
        pieces,
        lambda p, i: F.struct(
            (i + 1).alias("segment_no"), F.regexp_extract(p, f"^({id_pattern})", 1).alias("id"),
            F.trim(F.regexp_replace(F.regexp_replace(p, f"^(?:{id_pattern})", ""), r"\s+", " ")).alias("body"),
        ),
    )


def keyword_sections(c: str | Column, keywords: Sequence[str], shortest: int = 20, longest: int | None = None) -> Column:
    """Text cut before each keyword; pieces with a keyword and a fitting length."""
    words = alternation(keywords)
    pieces = F.split(F.regexp_replace(col(c), f"({words})", "\x01$1"), "\x01")
    fits = lambda p: F.length(p) > shortest if longest is None else (F.length(p) > shortest) & (F.length(p) < longest)
    return F.filter(pieces, lambda p: p.rlike(words) & fits(p))


def labelled_sections(c: str | Column, labels: Sequence[str] = ("推定年齢", "年齢")) -> Column:
    """Sections that start at a line with the first label the text has at all."""
    c = col(c)
    out = F.array().cast("array<string>")
    for label in reversed(list(labels)):
        cut = F.split(F.regexp_replace(c, f"(?m)^\\s*({label})", "\x01$1"), "\x01")
        out = F.when(F.size(cut) > 1, F.slice(cut, 2, ALL)).otherwise(out)
    return out


def document_section(c: str | Column) -> Column:
    """Fields of one labelled section of document text."""
    c = col(c)
    age = half_width(F.regexp_extract(c, r"年齢\s+(?:推定)?([０-９0-9]+)歳", 1))
    name = F.nullif(F.trim(F.regexp_extract(c, r"仮名\s+(.+?)(?:\s+(?:色柄|性別)|\n|$)", 1)), F.lit(""))
    squeeze = lambda x: F.nullif(F.regexp_replace(x, r"\s+", ""), F.lit(""))
    flags = F.array_compact(F.array(
        F.when(c.contains("未避妊"), "未避妊").when(c.contains("避妊済"), "避妊手術済"),
        F.when(c.contains("未去勢"), "未去勢").when(c.contains("去勢済"), "去勢手術済"),
    ))
    return F.struct(
        name.alias("name"),
        F.when(age != "", F.concat(F.lit("推定"), age, F.lit("歳"))).alias("age_estimate"),
        classify.gender(F.regexp_extract(c, r"性別\s+(メス|オス)", 1)).alias("gender"),
        F.nullif(F.trim(F.regexp_extract(c, r"色柄\s+([^\n]+)", 1)), F.lit("")).alias("color"),
        F.when(F.size(flags) > 0, F.array_join(flags, "、")).alias("health_status"),
        squeeze(F.regexp_extract(c, r"性格\s+([^\n]+?)(?:アピール|\n|$)", 1)).alias("personality"),
        squeeze(F.regexp_extract(c, r"(?s)アピールポイント\s+(.+?)(?:\n成猫|$)", 1)).alias("special_needs"),
    )


# ---- recognised text ---------------------------------------------------------------

# fixed values: words that begin a description of character
CHARACTER_WORDS = (
    "怖がり|慎重|活発|おっとり|甘えん坊|人懐っ|人なつ|臆病|元気|大人|穏やか|落ち着|マイペース|用病|病気"
)
# fixed values: flags of recognised text and their wording
RECOGNISED_FLAGS = [
    ("去勢手術済", ["去勢手術済", "去勢済"]), ("避妊手術済", ["避妊手術済", "避妊済"]),
    ("ワクチン接種済", ["混合ワクチン", "ワクチン接種"]), ("FIV/FeLV陰性", ["FIV/FeLV陰性"]),
]
GENTLE_TRIGGER = "急な動作"
GENTLE_ADVICE = "急な動作でびっくりしてしまうので、ゆったりと接してください"
LABELLED_FLAGS = [
    ("避妊去勢", "済|未実施|無", "避妊去勢済"), ("マイクロチップ", "有|無", "マイクロチップ無"),
    ("猫エイズ検査", "陰性|陽性|未検査", "猫エイズ検査陰性"), ("猫白血病検査", "陰性|陽性|未検査", "猫白血病検査陰性"),
]


def _character(squeezed: Column) -> Column:
    """The sentence that ends in 性格です, from its first word of character on."""
    sentence = F.regexp_extract(squeezed, r"([^\n。]+性格です)", 1)
    return F.nullif(
        F.coalesce(F.nullif(F.regexp_extract(sentence, f"((?:{CHARACTER_WORDS}).*)$", 1), F.lit("")), sentence), F.lit("")
    )


# fixed values: sentences on character that do not end in 性格です
MANNER = [
    r"([ぁ-ん]+(?:ん坊|的|気味)(?:で|な|、)[^\n。]+(?:です|ます))",
    r"((?:怖がり|慎重|活発|おっとり|人なつっこい)[^\n。]+(?:です|ます))",
]


def _manner(squeezed: Column) -> Column:
    """A sentence that tells a character in other words."""
    return F.coalesce(*(F.nullif(F.regexp_extract(squeezed, p, 1), F.lit("")) for p in MANNER))


def recognised(c: str | Column, layout: str) -> Column:
    """A listing from recognised text.  Recognition puts spaces between signs
    and confuses some of them: both are undone first, then one of three layouts
    applies (``labelled`` lines, ``prose``, ``slashed`` fields)."""
    raw = repair(c)
    both = F.struct(raw.alias("raw"), F.regexp_replace(raw, r"[ \t　]+", "").alias("squeezed"))
    return let(both, lambda t: _layout_fields(t["raw"], t["squeezed"], layout))


def _layout_fields(raw: Column, squeezed: Column, layout: str) -> Column:
    none = F.lit(None).cast("string")
    after = lambda label: F.nullif(F.regexp_extract(squeezed, f"{label}[:：]?([^\\n]+)", 1), F.lit(""))
    flags = F.array_compact(F.array(*[F.when(any_of(squeezed, w), F.lit(p)) for p, w in RECOGNISED_FLAGS]))
    health = F.when(F.size(flags) > 0, F.array_join(flags, "、"))
    needs = F.when(squeezed.contains(GENTLE_TRIGGER), GENTLE_ADVICE)

    if layout == "labelled":
        age_line = F.regexp_extract(squeezed, r"年[^\n齢静]*[齢静][:：]?([^\n]+)", 1)
        with_unit = F.regexp_extract(age_line, r"([0-9]+(?:歳半|歳|才|ヶ月|ヵ月|か月|週間|週))", 1)
        bare = F.regexp_extract(age_line, r"([0-9]+)", 1)
        stated = F.array_compact(F.array(*[
            F.when(
                squeezed.contains(label),
                F.coalesce(F.nullif(F.regexp_extract(squeezed, f"({label}[:：]?(?:{values}))", 1), F.lit("")), F.lit(default)),
            )
            for label, values, default in LABELLED_FLAGS
        ]))
        fields = {
            "inquiry_number": F.nullif(F.regexp_extract(raw, r"([0-9]{4})", 1), F.lit("")),
            "animal_type": F.when(any_of(squeezed, ["猫エイズ", "猫白血病"]), "cat").otherwise("dog"),
            "breed": F.regexp_extract(after("種類?"), r"^([^。、』】\]]+)", 1),
            "color": F.regexp_extract(after("毛色"), r"^([^。、]+)", 1),
            "gender": classify.gender(F.regexp_extract(squeezed, r"[性に]ヨ?別[:：]([^\n]+)", 1)),
            "age_estimate": F.coalesce(
                F.nullif(with_unit, F.lit("")), F.when(bare != "", F.concat(bare, F.lit("歳"))),
                F.nullif(F.concat(F.lit("推定"), F.regexp_extract(squeezed, r"推定([0-9]+(?:歳|才|ヶ月|ヵ月))", 1)), F.lit("推定")),
            ),
            "health_status": F.when(F.size(stated) > 0, F.array_join(stated, "、")),
            "personality": after("性格"),
            "special_needs": after("募集の経緯"),
        }
    elif layout == "prose":
        number = F.regexp_extract(squeezed, r"お問合せ番号一?([0-9O]{3})", 1)
        years = F.regexp_extract(squeezed, r"推定([0-9]+)歳", 1)
        fields = {
            "inquiry_number": F.nullif(F.translate(number, "O", "0"), F.lit("")),
            "animal_type": F.lit("cat"), "breed": none, "color": none,
            # the operation names the animal itself, other words may speak of its company
            "gender": F.when(squeezed.contains("去勢手術済オス"), "male").when(squeezed.rlike("(?:去勢|避妊)手術済メス"), "female")
            .when(squeezed.contains("避妊手術済オス"), "male")
            .when(squeezed.contains("オス"), "male").when(squeezed.contains("メス"), "female").otherwise("unknown"),
            "age_estimate": F.when(years != "", F.concat(years, F.lit("歳"))),
            "health_status": health, "personality": F.coalesce(_character(squeezed), _manner(squeezed)), "special_needs": needs,
        }
    elif layout == "slashed":
        estimated = F.regexp_extract(squeezed, r"(?:推定|約)([0-9]+)歳", 1)
        plain_age = F.regexp_extract(squeezed, r"[/／]([0-9]+)歳", 1)
        fields = {
            "inquiry_number": none, "animal_type": F.lit("cat"),
            "breed": F.nullif(F.regexp_extract(raw, r"(\S+)\s*[/／]\s*(?:男|女)\s*の\s*子", 1), F.lit("")),
            "color": F.nullif(F.regexp_extract(raw, r"[0-9]+\s*歳\s*[/／]\s*([^\s/／]+)", 1), F.lit("")),
            "gender": F.when(squeezed.contains("男の子"), "male").when(squeezed.contains("女の子"), "female")
            .when(squeezed.contains("オス"), "male").when(squeezed.contains("メス"), "female").otherwise("unknown"),
            "age_estimate": F.when(estimated != "", F.concat(F.lit("推定"), estimated, F.lit("歳")))
            .when(plain_age != "", F.concat(plain_age, F.lit("歳"))),
            "health_status": health, "personality": _character(squeezed), "special_needs": needs,
        }
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def from_pairs(entries: Column, labels: Mapping[str, Sequence[str]]) -> list[Column]:
    """Named fields out of key-value pairs, each by its own labels."""
    from .html import field

    return [field(entries, names).alias(name) for name, names in labels.items()]
