"""Classes of indicators as data: a class is met if, in one of its rules, every group of the
rule has a lexeme that the text contains. Texts are lower case with single spaces."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = list[list[str]]
_TEST_COUNT: list[Rule] = [[["количество"], ["тест", "выполняем", "определен"]]]
_MATERIAL: list[Rule] = [[["исследуем"], ["материал"]], [["материал"], ["исследован"]], [["биологическ"], ["материал"]]]
_SENSITIVITY: list[Rule] = [[["концентрац", "нг мл", "ng ml"], ["чувствител", "аналитическ", "минимальн", "равно", "больше", "менее"]]]
#: Lexemes of the indicator classes; the order gives the bits of a mask.
CLASSES: dict[str, list[Rule]] = {
    "test_count": _TEST_COUNT,
    "kitting": [[["комплект", "комлектац"]], [["различ"], ["комлекта", "определен"]]],
    "pack_quantity": [[["колич"], ["упаков", "упак", "устройств", "набор", "комплект"]]],
    "ph_range": [[["диапазон", "предел"], ["ph", "рн"], ["определя", "концентрац", "значен"]]],
    "ph_scale": [[["шкал"], ["цвет", "пол"], ["ph", "рн"]]],
    "sensitivity": _SENSITIVITY,
    "material": _MATERIAL,
    "composition": [[["состав", "комплектац", "описан"]]],
    "purpose": [[["назначен", "описан"]]],
    "infection": [[["выявлен", "маркер", "антител", "антиген"], ["вич", "hiv", "гепат", "hbsag", "сифил", "treponema"]]],
}
#: Classes whose members may stand for each other; test counts also stand for kitting and packs.
SAME = ["pack_quantity", "ph_range", "ph_scale", "sensitivity", "material", "composition", "purpose", "infection"]
EXCLUDED: list[Rule] = [[["код ктру"]]]
NAME_COLUMN: list[Rule] = [[["наименование товара", "наименование изделия"]], [["наименование"], ["товар", "товра"]]]
TEXT_CRITERION: list[Rule] = [
    [["выявляем"], ["веществ", "перечень"]],
    [["состав", "назначен", "комплектац", "описан", "камера смешивания образца"]],
    [["выявлен", "маркер"], ["вич", "гепат", "сифил"]],
    *_SENSITIVITY,
    *_MATERIAL,
    [["биологич"], ["материал"]],
]
#: Texts that may stand as values without a number (besides those of name columns).
TEXT_VALUE: list[Rule] = [[["выявляем"], ["веществ", "перечень"]], [["назначение", "комплектац", "описание"]], [["биологич"], ["материал"]], [["материал"], ["исследован"]]]
_FINGER = [["палец", "пальца"], ["кров", "цельной"], ["капилляр"]]
#: Categories of indicators in order of precedence, and what a met category weighs.
CATEGORIES: list[tuple[str, list[Rule]]] = [
    ("whole_capillary_blood_finger", [_FINGER, [["цельной крови", "цельная кровь", "цельной капиллярной крови", "капиллярной крови"], ["палец", "пальца"]]]),
    ("matrix_material", [[["материал", "источник", "тип образца"]]]),
    ("specificity_percent", [[["специфичн"]]]),
    ("relative_sensitivity_percent", [[["относит"]]]),
    ("analytical_sensitivity_ng_ml", [[["аналитическ", "предел обнаружения"]]]),
    ("sensitivity_percent", [[["чувствительность", "sensitivity"]]]),
]
WEIGHTS = {"analytical_sensitivity_ng_ml": 3, "sensitivity_percent": 3, "relative_sensitivity_percent": 2, "specificity_percent": 3, "matrix_material": 1, "whole_capillary_blood_finger": 2}
BLOOD_LEXEMES = ["кров", "сыворот", "плазм", "цельн"]


def meets(col: Column, rules: list[Rule]) -> Column:
    """Whether a text meets one of the rules; null stays null."""
    return reduce(or_, (reduce(and_, (reduce(or_, (F.contains(col, F.lit(w)) for w in group)) for group in rule)) for rule in rules))


def meets_sql(expr: str, rules: list[Rule]) -> str:
    """The same in SQL."""
    return "(" + " OR ".join("(" + " AND ".join("(" + " OR ".join(f"contains({expr}, '{w}')" for w in group) + ")" for group in rule) + ")" for rule in rules) + ")"


def class_mask(col: Column) -> Column:
    """Bit k is set if the text meets class k."""
    return reduce(lambda a, b: a + b, (F.when(meets(col, rules), F.lit(1 << k)).otherwise(F.lit(0)) for k, rules in enumerate(CLASSES.values())))


def class_mask_sql(expr: str) -> str:
    return " + ".join(f"CASE WHEN {meets_sql(expr, rules)} THEN {1 << k} ELSE 0 END" for k, rules in enumerate(CLASSES.values()))


def category(col: Column) -> Column:
    """The first category met, else 'other'."""
    out = F.lit("other")
    for name, rules in reversed(CATEGORIES):
        out = F.when(meets(col, rules), F.lit(name)).otherwise(out)
    return out


def category_sql(expr: str) -> str:
    return "CASE " + " ".join(f"WHEN {meets_sql(expr, rules)} THEN '{name}'" for name, rules in CATEGORIES) + " ELSE 'other' END"


def alias_keys(col: Column, side: str) -> Column:
    """Keys of which two indicators that may stand for each other share one: an equi-join instead of a theta join.

    side is "a" or "b"; a test count on one side meets kitting and packs on the other.
    """
    keys = [F.when(meets(col, CLASSES[c]), F.lit(c)) for c in SAME]
    count, kit = meets(col, CLASSES["test_count"]), meets(col, CLASSES["kitting"]) | meets(col, CLASSES["pack_quantity"])
    keys += [F.when(count if side == "a" else kit, F.lit("count>kit")), F.when(kit if side == "a" else count, F.lit("kit>count"))]
    return F.array_compact(F.array(*keys))
