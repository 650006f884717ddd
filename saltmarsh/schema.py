"""Tables of the library: columns, types, ownership of columns by source."""

from __future__ import annotations

from pyspark.sql import types as T

#: The nine measurements, all nullable.
MEASURES = ["wave_height_m", "wave_period_s", "wave_direction_deg", "current_velocity_kmh", "current_direction_deg", "sst_celsius", "sea_level_anomaly_m", "geostrophic_u_ms", "geostrophic_v_ms"]
BEARINGS = ["wave_direction_deg", "current_direction_deg"]

OBSERVATION = T.StructType(
    [T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("timestamp", T.LongType()), T.StructField("port_id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("is_forecast", T.BooleanType()), T.StructField("is_historical_cache", T.BooleanType())]
    + [T.StructField(c, T.DoubleType()) for c in MEASURES]
)

PLACE = "port_id string, port_name string, name_folded string, country_code string, country_name string, latitude double, longitude double, water_body string, harbor_size string, harbor_type string, source string, population long, marine_latitude double, marine_longitude double"
LEDGER = "dataset string, min_lat double, max_lat double, min_lon double, max_lon double, start_timestamp long, end_timestamp long, row_count long, fetched_at long"
GRID_POINT = "grid_id string, latitude double, longitude double, is_ocean boolean, is_valid boolean, fail_count int, last_checked long, last_success long"
TRACKED = "port_id string, port_name string, country_code string, country_name string, latitude double, longitude double, marine_latitude double, marine_longitude double, elevation_m double, added_at long, last_polled_at long, backfilled_to long"
SAVED = "name string, spec_json string, notes string, created_at long, last_run_at long, last_rows long"

#: What a source may overwrite; any other source owns everything.
OWNED = {
    "open_meteo": ["wave_height_m", "wave_period_s", "wave_direction_deg", "current_velocity_kmh", "current_direction_deg", "sst_celsius"],
    "erddap_sla": ["sea_level_anomaly_m", "geostrophic_u_ms", "geostrophic_v_ms"],
    "erddap_sst": ["sst_celsius"],
}
#: What a source may only fill where nothing is.
FILL_ONLY = {"erddap_sst": ["sst_celsius"]}

RAW_COLUMNS = ["time", "latitude", "longitude", "port_id", "wave_height_m", "wave_period_s", "wave_direction_deg", "wave_power_kw_m", "current_velocity_kmh", "current_direction_deg", "sst_celsius", "sea_level_anomaly_m", "geostrophic_u_ms", "geostrophic_v_ms", "is_forecast", "sources"]

#: column: (unit, nature, provider, meaning). Nature: measurement, analysis (observations and a model for
#: a past time), model (nothing was measured), derived (worked out here) or metadata.
DICTIONARY = {
    "time": ("UTC", "metadata", "derived", "time of the reading"),
    "window_start": ("UTC", "metadata", "derived", "start of the window, which belongs to it"),
    "latitude": ("degrees", "metadata", "source grid", "cell centre as the provider gives it, north positive"),
    "longitude": ("degrees", "metadata", "source grid", "cell centre, east positive, -180 to 180"),
    "port_id": ("", "metadata", "NGA World Port Index / GeoNames", "tracked port that the reading was asked for; empty for cells of the global grid"),
    "wave_height_m": ("m", "model", "Open-Meteo Marine", "significant wave height; single waves reach nearly twice as high"),
    "wave_period_s": ("s", "model", "Open-Meteo Marine", "period of the most energetic waves"),
    "wave_direction_deg": ("degrees", "model", "Open-Meteo Marine", "direction that waves come from"),
    "current_velocity_kmh": ("km/h", "model", "Open-Meteo Marine", "surface current speed, wind-driven flow included"),
    "current_direction_deg": ("degrees", "model", "Open-Meteo Marine", "direction that the current flows to"),
    "sst_celsius": ("degC", "analysis", "Open-Meteo Marine / NOAA OISST v2.1", "sea surface temperature: hourly from the model, older days from the satellite analysis"),
    "sea_level_anomaly_m": ("m", "measurement", "NOAA CoastWatch altimetry", "sea surface above its long-term mean, not above a land datum; months in arrears"),
    "geostrophic_u_ms": ("m/s", "measurement", "NOAA CoastWatch altimetry", "eastward current from the slope of the sea surface; not near the equator"),
    "geostrophic_v_ms": ("m/s", "measurement", "NOAA CoastWatch altimetry", "northward current from the slope of the sea surface"),
    "wave_power_kw_m": ("kW/m", "derived", "derived", "wave energy flux per metre of crest; the peak period makes it some 11% high"),
    "wave_height_m_max": ("m", "derived", "derived", "highest significant wave height of the window"),
    "wave_power_kw_m_max": ("kW/m", "derived", "derived", "highest wave power of the window"),
    "wave_energy_kwh_m": ("kWh/m", "derived", "derived", "mean power times the hours of the window; 0 without readings"),
    "observation_count": ("count", "derived", "derived", "readings in the window; 0 without any"),
    "cumulative_observations": ("count", "derived", "derived", "readings so far"),
    "cumulative_wave_energy_kwh_m": ("kWh/m", "derived", "derived", "energy so far"),
    "is_forecast": ("", "metadata", "derived", "the reading lies ahead of its download"),
    "sources": ("", "metadata", "derived", "sources that contributed, in order of arrival"),
    "distance_km": ("km", "derived", "derived", "great-circle distance from the centre asked for"),
}
#: provider: (role, nature, licence, address, coverage), facts of the providers themselves.
PROVIDERS = {
    "Open-Meteo Marine": ("waves, currents, recent sea surface temperature", "numerical wave model", "CC BY 4.0", "https://open-meteo.com/", "waves from 2021-12, currents from 2022-01, temperature from 2022-12"),
    "NOAA OISST v2.1": ("sea surface temperature of the past", "daily 0.25 degree analysis of satellite and in-situ data", "public domain (U.S. Government work)", "https://coastwatch.pfeg.noaa.gov/erddap/", "1981-09 to about two weeks ago"),
    "NOAA CoastWatch altimetry": ("sea level and geostrophic currents", "gridded satellite altimetry", "public domain (U.S. Government work)", "https://coastwatch.pfeg.noaa.gov/erddap/", "from 2017-02, months in arrears"),
    "NGA World Port Index": ("ports", "gazetteer", "public domain (U.S. Government work)", "https://msi.nga.mil/Publications/WPI", "2,951 ports"),
    "GeoNames": ("coastal places", "gazetteer", "CC BY 4.0 (attribution required)", "https://www.geonames.org/", "coastal settlements by an ocean mask"),
}
