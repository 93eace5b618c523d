"""Code lists of the market documents and of the intervention table."""

from __future__ import annotations

# Published code lists.
PRODUCTION_TYPES = {
    "B01": "Biomass",
    "B02": "Fossil Brown coal/Lignite",
    "B03": "Fossil Coal-derived gas",
    "B04": "Fossil Gas",
    "B05": "Fossil Hard coal",
    "B06": "Fossil Oil",
    "B07": "Fossil Oil shale",
    "B08": "Fossil Peat",
    "B09": "Geothermal",
    "B10": "Hydro Pumped Storage",
    "B11": "Hydro Run-of-river and poundage",
    "B12": "Hydro Water Reservoir",
    "B13": "Marine",
    "B14": "Nuclear",
    "B15": "Other renewable",
    "B16": "Solar",
    "B17": "Waste",
    "B18": "Wind Offshore",
    "B19": "Wind Onshore",
    "B20": "Other",
    "B25": "Energy storage",
}
RESOURCE_TYPES = {"A04": "generation", "A05": "load"}
FLOW_DIRECTIONS = {"A01": "up", "A02": "down"}
REDISPATCH_REASONS = {
    "A95": "Complementary information",
    "B24": "Load flow overflow",
    "B25": "Voltage level adjustment",
}
OUTAGE_REASONS = {
    "A95": "Complementary information",
    "B18": "Failure",
    "B19": "Forseen maintenance",
    "B20": "Shutdown",
    "B21": "Official exchange rate approved",
    "B22": "System regulation",
    "B23": "Frequency regulation",
    "B24": "Load flow overload",
    "B25": "Voltage level adjustment",
}
PARTY_ROLES = {
    "A32": "Market Operator",
    "A33": "Metered Data Responsible",
    "A39": "Data Provider",
    "A44": "Balance Responsible Party",
    "A45": "Metering Point Administrator",
    "A46": "System Operator",
    "A49": "Balance Service Provider",
}
CONTROL_AREAS = {
    "10YDE-EON------1": "DE_TenneT",
    "10YDE-VE-------2": "DE_50HzT",
    "10YDE-RWENET---I": "DE_Amprion",
    "10YDE-ENBW-----N": "DE_TransnetBW",
}
OUTAGE_TYPES = {"A53": "Planned", "A54": "Forced"}

# Reason keywords per coarse group, first group with a hit wins.
REASON_GROUPS = [
    ("Maintenance", "maintenance|planned maintenance|revision|inspection"),
    ("Failure", "failure|forced outage|unplanned outage|technical failure|equipment failure"),
    ("External", "external constraints|grid constraints|system operator request"),
    ("Redispatch", "redispatch"),
    ("Fuel", "fuel shortage|fuel supply|gas supply"),
    ("Environmental", "environmental|weather|temperature"),
    ("Testing", "testing|commissioning|trial operation"),
]

# Header and cell translations of the intervention table.
INTERVENTION_COLUMNS = {
    "BEGINN_DATUM": "begin_date",
    "BEGINN_UHRZEIT": "begin_time",
    "ENDE_DATUM": "end_date",
    "ENDE_UHRZEIT": "end_time",
    "NETZREGION": "region",
    "GRUND_DER_MASSNAHME": "measurement_reason",
    "RICHTUNG": "direction",
    "MITTLERE_LEISTUNG_MW": "mean_load",
    "MAXIMALE_LEISTUNG_MW": "max_load",
    "GESAMTE_ARBEIT_MWH": "total_load",
    "ANWEISENDER_UENB": "directing_operator",
    "ANFORDERNDER_UENB": "requesting_operator",
    "BETROFFENE_ANLAGE": "affected_unit",
    "PRIMAERENERGIEART": "primary_energy_type",
}
INTERVENTION_VALUES = {
    "measurement_reason": {
        "Strombedingter Redispatch": "Electricty-related redispatch",
        "Spannungsbedingter Redispatch": "Voltage-related redispatch",
        "Gezielter Leistungsausgleich bei Einspeisemanagement": "Target performance compensation for single-spot management",
        "Strom- und Spannungsbedingter RD": "Electricity- and voltage-related RD",
        "Strombedingter Countertrade DE-DK1": "Electricity-related countertrade DE-DK1",
        "Strombedingter Countertrade DE-DK2": "Electricity-related countertrade DE-DK2",
        "Strombedingter Countertrade DE-NO2": "Electricity-related countertrade DE-NO2",
        "Probestart (NetzRes)": "Testrun (NetzRes)",
        "Funktionstest (KapRes)": "Function test (KapRes)",
        "Testfahrt (KapRes)": "Testrun (KapRes)",
        "Probeabruf (KapRes)": "Test call (KapRes)",
        "Testfahrt (bnBm)": "Testrun (bnBm)",
        "Funktionstest (bnBm)": "Function test (bnBm)",
        "Probeabruf (bnBm)": "Test call (bnBm)",
    },
    "direction": {
        "Wirkleistungseinspeisung reduzieren": "down",
        "Wirkleistungseinspeisung erhöhen": "up",
        "Wirkleistungseinspeisung erh¿hen": "up",
    },
    "primary_energy_type": {
        "Erneuerbar": "Renewable",
        "Konventionell": "Conventional",
        "Sonstiges": "Special",
    },
}
