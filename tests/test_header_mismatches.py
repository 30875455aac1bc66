from __future__ import annotations

import math

from skylode.plans import catalogue


def test_every_row_is_compared_as_far_as_it_can_be_read(spark, tmp_path):
    day = 57000.25
    late = 2 / 86400
    refs = {"a": (100.0, 200.0, day), "b": (math.nan, 200.0, day), "c": (100.0, 200.0, math.nan), "d": (None, None, None)}
    headers = [(k, f"/x/n_guppi_57000_1_T{ref}_0001.rawspec.0000.h5", "0000", None, *v) for k, (ref, v) in enumerate(refs.items())]
    spark.createDataFrame(headers, "header_id long, file string, product string, parse_error string, f_start_mhz double, f_stop_mhz double, tstart_mjd double").write.parquet(f"{tmp_path}/scan_headers.parquet")
    cases = [
        ("a", "100.0", "200.0", f"{day:.8f}", False, False),
        ("a", "100.0", "200.0", f"{day + 2_400_000.5:.8f}", False, False),
        ("a", "100.0", "200.0", f"{day + late + 2_400_000.5:.8f}", False, True),
        ("a", "100,0", "201.0", "n/a", True, False),
        ("a", "NaN", "200.0", "NaN", False, False),
        ("a", None, "201.0", None, True, False),
        ("a", "100.0", "200.0", f" +{day + late:.8f}".replace(".", ","), False, True),
        ("b", "150.0", "201.0", f"{day + late:.8f}", True, True),
        ("b", "150.0", "200.0", f"{day:.8f}", False, False),
        ("c", "101.0", "200.0", f"{day + late:.8f}", True, False),
        ("d", "101.0", "200.0", f"{day:.8f}", False, False),
    ]
    rows = [(k, f"n_guppi_57000_1_T{c[0]}_0001.rawspec.0001.h5", *c[1:4]) for k, c in enumerate(cases)]
    spark.createDataFrame(rows, "row_id long, file string, f_start_mhz string, f_stop_mhz string, tstart_mjd string").write.parquet(f"{tmp_path}/association_rows.parquet")
    got = {r["row_id"]: (r["band_vs_0000"], r["tstart_vs_0000"]) for r in catalogue.header_mismatches(spark, str(tmp_path)).collect()}
    assert got == {k: c[4:] for k, c in enumerate(cases)}
