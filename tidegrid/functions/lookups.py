"""Dimension values as small parameters; pass your own to replace them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grid operators, their aliases, neighbours, states, split method.
OPERATORS = ["50Hertz", "TenneT DE", "Amprion", "TransnetBW"]
OPERATOR_ALIASES = {
    "50Hertz": ["50Hertz", "50HzT", "DE_50HzT", "50Hertz_DE", "50H"],
    "TenneT DE": ["TenneT", "TenneT DE", "DE_TenneT", "TenneT_DE"],
    "Amprion": ["Amprion", "DE_Amprion", "Amprion_DE"],
    "TransnetBW": ["TransnetBW", "DE_TransnetBW", "TransnetBW_DE", "Transnet BW"],
}
OPERATOR_NEIGHBOURS = {
    "50Hertz": ["CZ", "DK", "DK_2", "PL"],
    "TenneT DE": ["BE", "DK", "DK_1", "NL"],
    "Amprion": ["BE", "FR", "LU", "NL"],
    "TransnetBW": ["AT", "CH", "FR"],
}
STATE_OPERATOR = {
    "Baden-Württemberg": "TransnetBW",
    "Bayern": "TenneT DE",
    "Berlin": "50Hertz",
    "Brandenburg": "50Hertz",
    "Bremen": "TenneT DE",
    "Hamburg": "50Hertz",
    "Hessen": "TenneT DE",
    "Mecklenburg-Vorpommern": "50Hertz",
    "Niedersachsen": "TenneT DE",
    "Nordrhein-Westfalen": "Amprion",
    "Rheinland-Pfalz": "Amprion",
    "Saarland": "Amprion",
    "Sachsen": "50Hertz",
    "Sachsen-Anhalt": "50Hertz",
    "Schleswig-Holstein": "TenneT DE",
    "Thüringen": "50Hertz",
}
SPLIT_METHOD = {
    "50Hertz": "equal",
    "TenneT DE": "equal",
    "Amprion": "split",
    "TransnetBW": "equal",
}

# Generation types of one fuel group.
FUEL_GROUPS = {
    "wind_total": ["Wind_Onshore", "Wind_Offshore"],
    "solar": ["Solar"],
    "hydro_ror": ["Hydro_Run-of-river_and_poundage", "Hydro_Water_Reservoir"],
    "pumped_storage": ["Hydro_Pumped_Storage"],
    "thermal_coal": ["Fossil_Hard_coal", "Fossil_Brown_coal_Lignite"],
    "thermal_gas": ["Fossil_Gas", "Fossil_Coal-derived_gas"],
    "thermal_nuclear": ["Nuclear"],
    "thermal_other": ["Fossil_Oil", "Waste", "Other"],
    "bio_other_renewables": ["Biomass", "Geothermal", "Other_renewable"],
}


def lookup(value: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    """Value of a small mapping as an expression: no join, no exchange."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(table, value)
    return found if default is None else F.coalesce(found, default)


def canonical_operator(name: Column) -> Column:
    """Alias to canonical operator name; unknown names pass through."""
    flat = {alias: op for op, names in OPERATOR_ALIASES.items() for alias in names}
    return lookup(name, flat, name)


def split_method(operator: Column) -> Column:
    return lookup(canonical_operator(operator), SPLIT_METHOD, F.lit("equal"))


def operator_of_state(state: Column) -> Column:
    return lookup(state, STATE_OPERATOR)


def neighbours(operator: Column) -> Column:
    table = F.create_map(
        *[
            x
            for op, ns in OPERATOR_NEIGHBOURS.items()
            for x in (F.lit(op), F.array(*[F.lit(n) for n in ns]))
        ]
    )
    return F.try_element_at(table, canonical_operator(operator))


def is_known_operator(name: Column) -> Column:
    return canonical_operator(name).isin(OPERATORS)


def fuel_group(fuel: Column) -> Column:
    return lookup(fuel, {f: g for g, fs in FUEL_GROUPS.items() for f in fs})
