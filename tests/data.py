"""A small catalogue and item payloads, as tables of facts."""

import csv

from matchloom.operators.catalogue import SOURCE_COLUMNS

# Invented products: a spotlight under one code in two outputs, and three recessed lights, of which one contradicts itself
# and one has a public code alone.
SPOT = {
    "hinban": "QLA1207", "kidou": "D2", "key": "S-12", "view_key": "スポットライト 820lm", "kigugroup": "スポットライト", "kigustyle": "ダクト形", "price_zeinuki": "18400",
    "zaiku": "受注品", "t_akarusa": "820lm", "kigusize": "W60×L210", "t_toritsuke": "配線ダクト", "boushitsu_bouu": "防湿", "t_kinou": "調光", "bumon": "東", "hatsubai_date": "2021/4/1",
}
RECESSED = SPOT | {"kigugroup": "ユニバーサルダウンライト", "kigustyle": "丸形", "t_toritsuke": "天井埋込", "kigusize": ""}
ROWS = [
    SPOT | {"id": "A1"},
    SPOT | {"id": "A2", "key": "S-30", "view_key": "スポットライト 2050lm", "t_akarusa": "2050lm"},
    RECESSED | {"id": "A3", "hinban": "RVK880B", "key": "R-88 3000K 埋込穴88", "view_key": "620lm", "zaiku": "生産終了予定品", "umekomi_ana": "φ88", "t_kinou": "固定出力"},
    RECESSED | {"id": "A4", "hinban": "ZTM44", "key": "軒下", "view_key": "", "umekomi_ana": "□90", "boushitsu_bouu": "対応なし", "t_kinou": "防雨形"},
    RECESSED | {"id": "A5", "hinban": "KOM7", "kidou": "", "key": "施設", "view_key": "300lm", "umekomi_ana": "φ200", "koukyou_kataban1": "PB2-300"},
]


def write_csv(path, rows=ROWS, columns=SOURCE_COLUMNS):
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.DictWriter(f, columns, restval="")
        out.writeheader()
        out.writerows(rows)
    return str(path)


def item(identity=None, specifications=None, **top):
    return {"identity": identity or {}, "specifications": specifications or {}} | top
