"""Record schemas."""

from __future__ import annotations

WEATHER_PAYLOAD = (
    "name string, main struct<temp:string,humidity:string,pressure:string>, wind struct<speed:string>, "
    "clouds struct<all:string>, coord struct<lat:string,lon:string>, dt string, "
    "weather array<struct<description:string>>"
)
RECOMMENDATION = "struct<severity:string,message:string,action:string>"
OBSERVATION = (
    "run_id long, observation_time timestamp_ntz, city string, latitude double, longitude double, "
    "cloud_cover_pct double, wind_speed_ms double, ambient_temp_c double, humidity_pct double, label string, "
    "detection_confidence double"
)
