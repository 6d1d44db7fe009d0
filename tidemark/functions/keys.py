"""Entity keys: ordered (name, value) parts, encoded as `name=value` joined by `|`."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_error(parts: Mapping[str, Column]) -> Column:
    """Why the parts cannot be encoded, or null: a blank or null value, or one that holds a separator."""
    out = F.lit(None).cast("string")
    for name, col in reversed(parts.items()):
        value = col.cast("string")
        bad = F.when(value.isNull() | (F.trim(value) == ""), F.lit(f"blank key value: {name}")).when(value.rlike("[|=]"), F.lit(f"reserved character in key value: {name}"))
        out = F.coalesce(bad, out)
    return out


def entity_key(parts: Mapping[str, Column], order: Sequence[str] | None = None) -> Column:
    """The encoded key, null where `key_error` has something to say.

    Without an order the names sort alphabetically; with one, it must name exactly the same parts."""
    for name in parts:
        if not name.strip() or set(name) & {"|", "="}:
            raise ValueError(f"bad key name {name!r}")
    if order is not None and (len(set(order)) != len(order) or set(order) != set(parts)):
        raise ValueError(f"the order {list(order)} must name the parts {sorted(parts)}")
    names = list(order) if order is not None else sorted(parts)
    text = F.concat_ws("|", *(F.concat(F.lit(n + "="), parts[n].cast("string")) for n in names))
    return F.when(key_error(parts).isNull(), text)


def key_part(key: Column, name: str) -> Column:
    """One part's value out of an encoded key."""
    return F.try_element_at(F.str_to_map(key, F.lit("[|]"), F.lit("=")), F.lit(name))
