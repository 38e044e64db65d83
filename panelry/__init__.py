"""Panel analytics over drifting editions of wide survey tables, on Spark."""

from panelry import fixed
from panelry.errors import InvalidQuery, MissingColumns, NoRows
from panelry.functions.codes import add_region, label
from panelry.functions.text import slug
from panelry.operators.aggregates import (
    count_by,
    distribution,
    overview_by_uf,
    rate,
    rate_by,
    sum_by,
    time_series,
    top_areas,
)
from panelry.operators.areas import (
    Cut,
    aggregation_for,
    area_aggregate,
    class_ranges,
    coverage_warnings,
    dominant_category,
    join_mesh,
    mesh_coverage,
    quantile_breaks,
    quantile_classes,
    usable_years,
    year_fitness,
)
from panelry.operators.catalog import (
    audit_gaps,
    audit_missing_only_in,
    columns_per_edition,
    common_columns,
    edition_catalog,
    presence_matrix,
    presence_summary,
)
from panelry.operators.cuts import cut_from_address, parse_addresses, parse_cuts, parse_lines
from panelry.operators.dictionary import (
    audit_unstable,
    audit_with_domain,
    cast_to_series,
    data_dictionary,
    describe_variable,
    latest_descriptions,
    most_empty,
    normalize_dictionary,
    pick_dictionary_files,
    pick_sheets,
    series_schema,
    sheets_without_header,
)
from panelry.operators.profile import (
    audit_conflicts,
    audit_wide_prefixes,
    profile,
    profile_editions,
    promoted_types,
    types_by_year,
)
from panelry.operators.sample import (
    file_position,
    Sample,
    numbers_where_lossless,
    sample_head,
    sample_scan,
    where_contains,
    where_equals,
)
from panelry.operators.stack import (
    enrich_edition,
    load_edition,
    load_panel,
    stack_editions,
    upsert_by_key,
)
from panelry.plans.maps import (
    MapSpec,
    area_tables,
    build_all_maps,
    build_map,
    read_map,
    resolved_maps,
    write_all_maps,
    write_map,
)
from panelry.plans.preparation import prepare_panel
from panelry.sources.editions import (
    apply_prefix_types,
    discover_editions,
    edition_exists,
    list_files,
    open_edition,
    open_editions,
    read_edition,
    read_edition_text,
    read_editions,
    write_edition,
    write_editions,
)
from panelry.sources.records import parse_records, to_record
from panelry.sources.tables import (
    geojson_features,
    parse_meshes,
    read_dictionary,
    read_mesh,
    write_area_table,
    write_dictionary,
    write_geojson_features,
    write_sample,
)

__all__ = [name for name in dir() if not name.startswith("_")]
