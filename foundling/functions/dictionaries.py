"""Word lists, patterns and thresholds.

Everything here is a parameter: each operator takes its own list and these are
only the defaults.  Fixed values: they must be as they are for right results on
Japanese listings.
"""

from __future__ import annotations

# fixed values: species words (first match wins: dog before cat)
DOG_WORDS = ["犬", "イヌ", "いぬ", "ワンちゃん", "わんちゃん", "ワンコ", "わんこ", "dog", "Dog", "DOG"]
CAT_WORDS = ["猫", "ネコ", "ねこ", "ニャンちゃん", "にゃんちゃん", "ニャンコ", "にゃんこ", "cat", "Cat", "CAT"]
DOG_HEADINGS = ["譲渡犬", "保護犬", "収容犬", "犬の紹介", "犬紹介"]
CAT_HEADINGS = ["譲渡猫", "保護猫", "収容猫", "猫の紹介", "猫紹介"]

# fixed values: phrases that mean an animal has found a home
ADOPTED_PHRASES = [
    "譲渡済み", "譲渡しました", "譲渡決定", "※譲渡しました", "新しい飼い主さんが決まりました",
    "決まりました", "譲渡先決定", "里親決定", "引き取られました", "飼い主が決まりました",
]
APPLICANT_PHRASES = ["申込者あり"]
NEGOTIATION_PHRASES = ["譲渡希望者と交渉中です"]

# fixed values: gender words
FEMALE_WORDS = ["メス", "めす", "雌", "♀", "女の子", "避妊", "不妊", "female"]
MALE_WORDS = ["オス", "おす", "雄", "♂", "男の子", "去勢", "male"]
NEUTER_WORDS = ["去勢", "避妊", "不妊"]

# fixed values: size words, largest first
SIZE_WORDS = [("large", ["大型", "大きい", "大"]), ("medium", ["中型", "中"]), ("small", ["小型", "小さい", "小"])]

# fixed values: age wording
AGE_PATTERN = r"(?:生後|約)?([0-9]+)(?:歳|才|ヶ月|か月|ヵ月)"
AGE_UNITS_MONTHS = [("歳", 12), ("才", 12), ("ヶ月", 1), ("か月", 1), ("ヵ月", 1), ("カ月", 1)]
AGE_STAGES = [("子供", ["子猫", "仔猫", "子犬"]), ("成体", ["成猫", "成犬"]), ("シニア", ["シニア", "高齢"])]

# fixed values: breeds and colours, in list order
BREEDS = ["雑種", "ミックス", "日本猫", "洋猫", "アメショー", "ペルシャ", "ロシアンブルー"]
COLOURS = ["白", "黒", "茶", "灰", "三毛", "みけ", "キジ", "サビ", "茶白", "白黒", "グレー", "クリーム"]

# fixed values: keywords whose surroundings are kept
HEALTH_WORDS = ["健康", "ワクチン", "去勢", "避妊", "病気", "治療", "薬", "手術"]
PERSONALITY_WORDS = ["性格", "人懐っこい", "おとなしい", "活発", "甘えん坊", "臆病", "元気", "大人しい"]
SPECIAL_WORDS = ["特別", "注意", "投薬", "介護", "ケア", "障害", "病気"]

# fixed values: test results
TEST_RESULTS = [("negative", ["陰性"]), ("positive", ["陽性"]), ("not_tested", ["未実施"])]

# fixed values: misread characters and what they stand for
OCR_REPAIRS = [("メメス", "メス"), ("カ月", "ヵ月"), ("誰性", "陰性"), ("部妊", "避妊"), ("准定", "推定")]

# fixed values: eras (name, letter, year before the first)
ERAS = [("令和", "R", 2018), ("平成", "H", 1988), ("昭和", "S", 1925)]

# fixed values: labels of run-on records
LABELS = ["仮名", "名前", "種類", "品種", "推定年齢", "年齢", "性別", "毛色", "体重", "更新日"]

# fixed values: headings that are not listings
HEADING_STOPS = [
    "愛護センター", "トップページ", "譲渡に関すること", "飼い主募集", "知っておきたいこと",
    "他の保護施設", "動画はこちら",
]
DECORATIVE_IMAGES = ["icon", "logo", "button", "clearspacer", "no_gazou", "noimage", "banner"]

# fixed values: names
PLACEHOLDER_NAME = "保護動物"
NAME_PREFIX = {"cat": "保護猫", "dog": "保護犬"}
NAME_SUFFIX_RULES = [("dog", ["くん"]), ("cat", ["ちゃん"])]
HONORIFICS = r"(?:くん|ちゃん|君)$"

# fixed values: mention counters of the cross-check
MENTIONS = {
    "gender": r"オス|メス|♂|♀",
    "age": r"推定年齢|生後|歳|ヶ月|か月",
    "breed": r"トイプードル|ミニチュアダックス|柴犬|雑種|ミックス|日本猫",
    "cat": r"猫|ネコ|ねこ",
    "dog": r"犬|イヌ|いぬ",
}

# fixed values: prefectures of each area, in the order shown
AREAS = {
    "北海道": ["北海道"],
    "東北": ["青森県", "岩手県", "宮城県", "秋田県", "山形県", "福島県"],
    "関東": ["茨城県", "栃木県", "群馬県", "埼玉県", "千葉県", "東京都", "神奈川県"],
    "中部": ["新潟県", "富山県", "石川県", "福井県", "山梨県", "長野県", "岐阜県", "静岡県", "愛知県"],
    "関西": ["三重県", "滋賀県", "京都府", "大阪府", "兵庫県", "奈良県", "和歌山県"],
    "中国": ["鳥取県", "島根県", "岡山県", "広島県", "山口県"],
    "四国": ["徳島県", "香川県", "愛媛県", "高知県"],
    "九州・沖縄": ["福岡県", "佐賀県", "長崎県", "熊本県", "大分県", "宮崎県", "鹿児島県", "沖縄県"],
}
