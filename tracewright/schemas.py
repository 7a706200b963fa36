"""Declared schemas of the artifact tables; nothing is inferred."""

from __future__ import annotations

BOX = "struct<x:bigint,y:bigint,w:bigint,h:bigint>"
ANCHOR = "struct<pixel:double,value:double>"
PANEL_HINT = f"struct<index:int,month:int,label:string,bbox_px:array<int>,plot_area_px:array<int>,x_start:string,x_end:string,n_series:int,series_labels:array<string>,y_anchors:array<{ANCHOR}>>"
HINTS = f"station string, year int, unit string, y_scale string, n_series int, series_labels array<string>, rotation_deg int, expected_panels int, panel_layout string, y_anchors array<{ANCHOR}>, baseline_visible boolean, panels array<{PANEL_HINT}>, notes string"
#: Keys that hints may have, at the top and in their parts.
HINT_KEYS = {
    "$": [
        "station",
        "year",
        "unit",
        "y_scale",
        "n_series",
        "series_labels",
        "rotation_deg",
        "expected_panels",
        "panel_layout",
        "y_anchors",
        "baseline_visible",
        "panels",
        "notes"
    ],
    "panels": ["index", "month", "label", "bbox_px", "plot_area_px", "x_start", "x_end", "n_series", "series_labels", "y_anchors"],
    "y_anchors": ["pixel", "value"],
}

PANEL = f"struct<panel_id:string,label:string,month:int,n_series:int,series_labels:array<string>,bbox_px:{BOX},plot_area_px:{BOX},confidence:double,flags:array<string>>"
TICK = "struct<pixel:double,value:double,label_text:string,used:boolean,residual:double>"
FIT = "struct<method:string,slope:double,intercept:double,scale:string,r2:double,rmse_value:double,n_ticks:int,n_used:int,n_rejected:int>"
CANDIDATE = "struct<cand_id:bigint,confidence:double,coverage:double,s_alpha:double,viable:boolean,points_px_tile:array<array<double>>>"
ARTIFACTS = {
    "panels": f"schema_version int, panels array<{PANEL}>, flags array<string>",
    "calibration": f"schema_version int, panels map<string,struct<y_axis:struct<scale:string,ticks:array<{TICK}>,fit:{FIT},confidence:double,flags:array<string>>,x_axis:struct<kind:string,start:string,end:string,n_samples:int>,review_required:boolean>>",
    "lines": f"schema_version int, tiles map<string,struct<error:string,fallback_used:boolean,candidates:array<{CANDIDATE}>,rejected:array<bigint>>>",
    "series": "schema_version int, panels map<string,struct<csv_path:string,panel_id:string,series_id:string,n:int,x_kind:string,gaps:array<string>,cand_id:bigint>>",
    "qc": "schema_version int, panels map<string,struct<verdict:string,issues:array<string>,reason:string,suggested_action:string,confidence:double>>",
    "tiles": "schema_version int, tiles array<struct<tile_id:string,path:string,panel_id:string,transform:struct<crop_x:double,crop_y:double,x_scale:double,y_scale:double>,width:int,height:int>>",
    "metadata": "schema_version int, title string, station string, year int, y_unit_declared string",
    "manifest": "schema_version int, run_id string, stages map<string,struct<status:string,error:string>>",
}
#: Defaults that belong to the schema, by artifact field.
DEFAULTS = {"schema_version": 1}

SERIES_CSV = "x_key string, value_native double, native_unit string, value_mm double, pixel_x_page double, pixel_y_page double, pixel_y_corrected double, flagged boolean"
GROUND_TRUTH_CSV = "INDEX int, C_X int, C_Y int, DATE_ string, GAUGELEVEL double, ICE string, REMARKS string, date_2 string, GAUGELEVEL_NO_ADJUSTMENT double"
GAUGES_CSV = "gauge_id string, gauge_name string"
OBSERVATIONS_CSV = "date date, gauge_id string, waterlevel_mm double, confidence double, coverage double, pixel_x double, pixel_y double, notes string"
EVALUATION_CSV = "location string, file_id int, month int, confidence double, coverage double, maxae double, avg_dev double, rmse double, mae double, pearson_r double, peak_score double, isBest string"
