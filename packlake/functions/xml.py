"""Column expressions over shredded XML (see `operators.shred`)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def xml_attr(attrs: str, name: str) -> Column:
    """Value of an attribute: exact qualified name first, else the first attribute with the
    same local name (which must itself be prefixed if `name` is)."""
    local = name.rsplit(":", 1)[-1]
    prefixed = " AND contains(a.name, ':')" if ":" in name else ""
    return F.expr(
        f"coalesce(get(filter({attrs}, a -> a.name = '{name}'), 0).value, "
        f"get(filter({attrs}, a -> substring_index(a.name, ':', -1) = '{local}'{prefixed}), 0).value)"
    )


def is_element(local: str, *events: str) -> Column:
    """Rows of an element with this local name; any of `events` (Start/Empty/End)."""
    listed = ", ".join(f"'{e}'" for e in events)
    # False, not null, for text.
    return F.expr(f"coalesce(local = '{local}', false) AND event IN ({listed})")
