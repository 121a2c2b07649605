"""Fixed table schemas, as DDL text."""

READINGS = (
    "event_id bigint, mac string, ts timestamp, data_format int, temperature double, humidity double, "
    "pressure double, acceleration_x double, acceleration_y double, acceleration_z double, "
    "battery_voltage double, tx_power int, movement_counter int, measurement_sequence int, rssi int"
)

FORECAST_FIELDS = [
    "temperature", "humidity", "pressure", "wind_speed", "wind_direction",
    "precipitation", "cloud_cover", "visibility", "uv_index", "weather_code",
]

# Which measurement each reading field belongs to (fixed values).
FIELD_MEASUREMENT = {
    "temperature": "environmental",
    "humidity": "environmental",
    "pressure": "environmental",
    "acceleration_x": "motion",
    "acceleration_y": "motion",
    "acceleration_z": "motion",
    "movement_counter": "motion",
    "battery_voltage": "power",
    "tx_power": "power",
    "rssi": "signal",
    "measurement_sequence": "signal",
}

ERROR_FIELDS = [
    "temp_abs_error", "temp_signed_error",
    "pressure_abs_error", "pressure_signed_error",
    "humidity_abs_error", "humidity_signed_error",
]

SENSOR_STRUCT = (
    "struct<name:string,location:string,discovered_at:string,last_seen:string,status:string,"
    "enabled:boolean,notes:string,firmware_version:string,battery_level:double>"
)

# Physical ranges: of the sensor, and the wider ones (fixed values).
RANGE_SPEC = {
    "temperature": (-40.0, 85.0),
    "humidity": (0.0, 100.0),
    "pressure": (300.0, 1100.0),
    "battery_voltage": (1.8, 3.6),
}

RANGE_SPEC_WIDE = {
    "temperature": (-40.0, 85.0),
    "humidity": (0.0, 100.0),
    "pressure": (300.0, 1100.0),
    "battery_voltage": (1.0, 4.0),
    "acceleration_x": (-32.0, 32.0),
    "acceleration_y": (-32.0, 32.0),
    "acceleration_z": (-32.0, 32.0),
    "rssi": (-120.0, 0.0),
}
