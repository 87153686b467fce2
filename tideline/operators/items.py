"""Item lines and order headers out of validated events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline import vocab
from tideline.functions import payload as pl
from tideline.functions.once import once
from tideline.functions.text import trimmed_text

_TEXT = (
    "item_id", "variant_id", "sku", "item_type", "item_class_id", "surface", "search_term",
    "ranking_run_id", "ranking_version", "list_instance_id", "impression_batch_id",
    "cart_id", "checkout_id", "order_id", "order_line_id", "currency",
)
_INT = ("position", "page", "viewport_width", "viewport_height")
_DECIMAL = {
    "visible_ratio": "decimal(8,4)", "quantity": "decimal(18,6)", "unit_price": "decimal(18,4)",
    "gross_amount": "decimal(18,4)", "net_amount": "decimal(18,4)",
    "discount_amount": "decimal(18,4)", "unit_cost": "decimal(18,4)", "cost_amount": "decimal(18,4)",
}
_ORDER_TEXT = (
    "cart_id", "checkout_id", "order_id", "currency",
    "payment_method_id", "payment_provider", "shipping_method_id",
)
_ORDER_AMOUNTS = (
    "subtotal_amount", "discount_amount", "shipping_amount", "tax_amount",
    "gross_amount", "net_amount", "cost_amount",
)
_EVENT = (
    "event_id", "logical_event_id", "tenant_id", "site_id", "site_code", "event_name",
    "event_time", "received_at", "anonymous_id", "session_id", "user_id",
)


def lines(events: DataFrame, applies: Column) -> DataFrame:
    """Adds `lines`, the line objects of a payload: `items` objects, else `item`, else the payload itself when it
    names an item. An empty object stands for a payload without lines of its own.

    Every step is taken once: a filter that the optimizer infers from exploding the lines names them again, and behind a
    join it would be the join's condition.
    """
    whole = pl.members(F.col("properties"), ("items", "item", "item_id"))
    taken = once(events, {"_p": F.when(applies, whole)})
    objects = F.filter(F.try_variant_get("_p.items", "$", "array<variant>"), lambda x: pl.is_object(x))
    read = once(taken, {"_items": objects, "_item": F.col("_p.item")})
    own = pl.as_text(F.col("_p.item_id")) != ""
    found = (
        F.when(F.coalesce(F.size("_items"), F.lit(0)) > 0, F.col("_items"))
        .when(pl.is_object(F.col("_item")), F.array("_item"))
        .when(own, F.array(F.parse_json(F.lit("{}"))))
    )
    return once(read, {"lines": F.when(applies, found)}).drop("_items", "_item", "_p")


def missing_fields(event_name: Column, row) -> Column:
    """Fields a line lacks for scoring, in fixed order."""

    def lacks(name, applies):
        empty = row(name).isNull() if name.startswith("visible") else F.coalesce(row(name), F.lit("")) == ""
        return F.when(applies & empty, F.lit(name))

    impression = event_name == "item_impression"
    purchase = event_name == "purchase_completed"
    checks = [lacks("item_id", F.lit(True))]
    checks += [
        lacks(n, impression)
        for n in ("surface", "list_instance_id", "visible_ratio", "visible_time_ms")
    ]
    checks += [lacks(n, purchase) for n in ("order_id", "order_line_id")]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def with_lines(events: DataFrame) -> DataFrame:
    """Adds `lines`, NULL for events that carry no items."""
    return lines(events, F.col("event_name").isin(*vocab.ITEM_EVENTS))


_KEY_FIELDS = ("item_id", "variant_id", "surface", "list_instance_id", "order_id", "order_line_id")


def key_header(properties: Column) -> Column:
    """What the event says for lines without such a member of their own, as texts."""
    own = pl.members(properties, _KEY_FIELDS)
    return F.struct(*[pl.as_text(own[n]).alias(n) for n in _KEY_FIELDS])


def key_fields(line_array: Column, properties: Column, header: Column | None = None) -> Column:
    """The few line fields the duplicate layers need, as an array of structs.

    header: the event's own, where it has been taken once. Lambdas are interpreted, so a line is read in one pass, what it lacks
    comes ready from the header, and only texts that start or end with another than a plain mark are trimmed. A null member of
    the line is a VARIANT null, not NULL, so it hides the header's.
    """
    own = key_header(properties) if header is None else header
    read = F.transform(line_array, lambda x: pl.members(x, _KEY_FIELDS))

    def text(line, name):
        found = F.coalesce(F.try_variant_get(line[name], "$", "string"), F.lit(""))
        return F.when(line[name].isNull(), own[name]).otherwise(found)

    texts = F.transform(read, lambda x: F.struct(*[text(x, n).alias(n) for n in _KEY_FIELDS]))
    return F.transform(texts, lambda x: F.struct(*[trimmed_text(x[n]).alias(n) for n in _KEY_FIELDS]))


_MEMBERS = (*_TEXT, "category_ids", *_INT, "visible_time_ms", "rendered_at", *_DECIMAL, "metadata")


def item_rows(events: DataFrame, members: list[str] | None = None) -> DataFrame:
    """One row per line, with the line's members over the event's and coerced to column types.

    members: those to read where only some are wanted; the line's completeness is then left out, as it takes all of them.
    """
    inherited = [c for c in _EVENT if c in events.columns]
    names = _MEMBERS if members is None else [n for n in _MEMBERS if n in members]
    listed = with_lines(events).select(
        *inherited, "lines", pl.members(F.col("properties"), names).alias("_header")
    )
    exploded = listed.select(*inherited, "_header", F.posexplode("lines").alias("line_index", "line"))
    read = once(exploded, {"_line": pl.members(F.col("line"), names)})
    # A null member of the line is a VARIANT null, not NULL, so it hides the header's.
    merged = once(read, {n: F.coalesce(F.col(f"_line.{n}"), F.col(f"_header.{n}")) for n in names})
    value = F.col
    coerced = {
        **{n: pl.as_text(value(n)) for n in _TEXT},
        "category_ids": pl.as_text_list(value("category_ids")),
        **{n: pl.as_int(value(n)) for n in _INT},
        "visible_time_ms": pl.as_long(value("visible_time_ms")),
        "rendered_at": pl.as_time(value("rendered_at")),
        **{n: pl.as_number(value(n)).cast(t) for n, t in _DECIMAL.items()},
        "metadata": pl.object_or_empty(value("metadata")),
    }
    typed = merged.select(*inherited, "line_index", *[coerced[n].alias(n) for n in names])
    if members is not None:
        return typed
    marked = typed.withColumn("missing_fields", missing_fields(F.col("event_name"), F.col))
    incomplete = F.size("missing_fields") > 0
    flags = F.create_map(
        F.lit("missing_fields"), F.to_variant_object("missing_fields"),
        F.lit("incomplete_for_scoring"), F.parse_json(F.lit("true")),
    )
    kept = F.map_filter(
        F.parse_json("metadata").cast("map<string,variant>"),
        lambda k, _: ~k.isin("missing_fields", "incomplete_for_scoring"),
    )
    metadata = F.when(
        incomplete, F.to_json(F.to_variant_object(F.map_concat(kept, flags)))
    ).otherwise(F.col("metadata"))
    return marked.withColumns({"metadata": metadata, "incomplete_for_scoring": incomplete})


def order_rows(events: DataFrame) -> DataFrame:
    """One header per checkout or purchase; `properties.order` members go over the event's."""
    names = (*_ORDER_TEXT, *_ORDER_AMOUNTS, "metadata")
    inherited = [
        c for c in ("event_id", "tenant_id", "site_id", "site_code", "event_name", "event_time") if c in events.columns
    ]
    header = F.col("properties")
    rows = events.where(F.col("event_name").isin(*vocab.ORDER_EVENTS)).select(
        *inherited, pl.members(header, names).alias("_header"), pl.members(pl.member(header, "$.order"), names).alias("_order")
    )
    merged = once(rows, {n: F.coalesce(F.col(f"_order.{n}"), F.col(f"_header.{n}")) for n in names})
    return merged.select(
        *inherited,
        *[pl.as_text(F.col(n)).alias(n) for n in _ORDER_TEXT],
        *[pl.as_number(F.col(n)).cast("decimal(18,4)").alias(n) for n in _ORDER_AMOUNTS],
        pl.object_or_empty(F.col("metadata")).alias("metadata"),
    )


def stored(rows: DataFrame) -> DataFrame:
    """Empty text becomes NULL, except the item id, which is required."""
    fields = rows.schema.fields
    return rows.select(
        *[
            F.nullif(F.col(f.name), F.lit("")).alias(f.name)
            if f.dataType.simpleString() == "string" and f.name not in ("item_id", "metadata")
            else F.col(f.name)
            for f in fields
        ]
    )
