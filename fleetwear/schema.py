"""Names and fixed values of the sensor data model."""

from pyspark.sql import types as T

# Column order of the headerless reading files.
KEY_COLUMNS = ["unit", "cycle"]
SETTING_COLUMNS = ["set1", "set2", "set3"]
SENSOR_COLUMNS = [f"s{number}" for number in range(1, 22)]

# Sensors that stay flat over an engine's life.
FLAT_SENSORS = ["s1", "s5", "s6", "s10", "s16", "s18", "s19"]

# Trend tags (up, down, combined, other).
TAGS = ["u", "d", "c", "o"]

# Chart colour of each health state.
STATE_COLOURS = {0: "#8fd175", 1: "#fff07e", 2: "#f6b08c", 3: "#d9534f"}
OTHER_COLOUR = "black"

MASKED = -1.0

# Physical names of the columns.
PHYSICAL_NAMES = {
    "unit": "engine_id",
    "cycle": "flight_cycle",
    "set1": "altitude",
    "set2": "mach_number",
    "set3": "throttle_resolver_angle",
    "s1": "fan_inlet_temp_T2",
    "s2": "LPC_outlet_temp_T24",
    "s3": "HPC_outlet_temp_T30",
    "s4": "LPT_outlet_temp_T50",
    "s5": "fan_inlet_pressure_P2",
    "s6": "bypass_duct_pressure_P15",
    "s7": "HPC_outlet_pressure_P30",
    "s8": "fan_speed_Nf",
    "s9": "core_speed_Nc",
    "s10": "engine_pressure_ratio_epr",
    "s11": "HPC_static_pressure_Ps30",
    "s12": "fuel_flow_ratio_phi",
    "s13": "corrected_fan_speed_NRf",
    "s14": "corrected_core_speed_NRc",
    "s15": "bypass_ratio_BPR",
    "s16": "burner_fuel_air_ratio_farB",
    "s17": "bleed_enthalpy_htBleed",
    "s18": "demanded_fan_speed_Nf_dmd",
    "s19": "demanded_corrected_fan_speed_PCNfR_dmd",
    "s20": "HPT_coolant_bleed_W31",
    "s21": "LPT_coolant_bleed_W32",
    "state": "label",
    "dataset": "dataset_id",
}


def reading_schema(sensors: int = 21) -> T.StructType:
    """Schema of a reading file with header names."""
    doubles = SETTING_COLUMNS + SENSOR_COLUMNS[:sensors]
    return T.StructType(
        [T.StructField(name, T.IntegerType()) for name in KEY_COLUMNS]
        + [T.StructField(name, T.DoubleType()) for name in doubles]
    )
