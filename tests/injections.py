"""A base table, and changes to it with the exact differences they must give."""

from __future__ import annotations

import random
import unicodedata
from dataclasses import dataclass, field
from datetime import UTC, date, datetime, timedelta
from decimal import Decimal

import pyarrow as pa

NAMES = ["José", "Zoë", "Ängström", "Łukasz", "Søren", "Bjørn", "Renée", "Håkon", "Plain", "Çelik", "Niño", "Émile"]
SCHEMA = pa.schema(
    [("id", pa.int64()), ("name", pa.string()), ("amount", pa.decimal128(18, 4)), ("score", pa.float64()), ("qty", pa.int32()), ("flag", pa.bool_()), ("created_at", pa.timestamp("us")), ("event_date", pa.date32()), ("payload", pa.string())]
)


def base(n: int = 200, seed: int = 42) -> pa.Table:
    rng = random.Random(seed)
    rows = []
    for i in range(1, n + 1):
        r = rng.random()
        rows.append(
            {
                "id": i,
                "name": None if r < 0.02 else f"{rng.choice(NAMES)}_{i}",
                "amount": None if r < 0.04 else Decimal(rng.randint(-100000, 100000)) / 100,
                "score": None if r < 0.03 else rng.gauss(100, 15),
                "qty": None if r < 0.05 else rng.randint(-50, 50),
                "flag": None if r < 0.05 else rng.random() < 0.5,
                "created_at": datetime(2024, 1, 1) + timedelta(seconds=i, microseconds=rng.randrange(10**6)),
                "event_date": date(2024, 1, 1) + timedelta(days=i % 400),
                "payload": f'{{"n": {i}, "tag": "t{i % 7}", "meta": {{"ok": true}}}}',
            }
        )
    return pa.Table.from_pylist(rows, SCHEMA)


@dataclass
class Case:
    left: pa.Table
    right: pa.Table
    cells: dict[str, int] = field(default_factory=dict)
    left_only: int = 0
    right_only: int = 0
    status: dict[str, str] = field(default_factory=dict)
    identical: bool = False
    duplicate: bool = False
    assume_tz: str | None = None
    both: int | None = None


def _set(t: pa.Table, name: str, values, kind=None) -> pa.Table:
    i = t.schema.get_field_index(name)
    return t.set_column(i, pa.field(name, kind or t.schema.field(i).type), pa.array(values, kind or t.schema.field(i).type))


def _change(t: pa.Table, name: str, f, rows) -> pa.Table:
    values = t.column(name).to_pylist()
    for i in rows:
        values[i] = f(values[i])
    return _set(t, name, values)


def cases() -> dict[str, Case]:
    t = base()
    names = t.column("name").to_pylist()
    some = [3, 20, 77, 101, 150]
    filled = [i for i in range(200) if names[i] is not None]
    accented = [i for i in filled if not names[i].isascii()][:6]
    scores = t.column("score").to_pylist()
    new = _set(t.slice(0, 3), "id", [9001, 9002, 9003])
    utc = [x.replace(tzinfo=UTC) for x in t.column("created_at").to_pylist()]
    odd = t.rename_columns([*t.schema.names[:-1], 'we"ird ;c`o.l{}'])
    twice = t.append_column("Delta", pa.array(range(200))).append_column("delta", pa.array(range(200)))
    long = t.append_column("long_text", pa.array([f"{i}" * 5000 for i in range(200)]))
    sparse = t.append_column("sparse", pa.array([i if i % 100 == 0 else None for i in range(200)], pa.int64()))
    return {
        "row_added": Case(t, pa.concat_tables([t, new]), right_only=3),
        "row_deleted": Case(t, pa.concat_tables([t.slice(0, 10), t.slice(13)]), left_only=3),
        "value_changed": Case(t, _change(t, "score", lambda x: (x or 0) + 17.5, range(7)), {"score": 7}),
        "null_introduced": Case(t, _change(t, "name", lambda x: None, filled[:5]), {"name": 5}),
        "type_widened": Case(t, _set(t, "qty", t.column("qty").to_pylist(), pa.int64()), status={"qty": "widening"}),
        "column_added": Case(t, t.append_column("extra", pa.array(["x"] * 200)), status={"extra": "only_right"}),
        "column_dropped": Case(t, t.drop_columns(["payload"]), status={"payload": "only_left"}),
        "column_renamed": Case(t, t.rename_columns([n if n != "flag" else "is_flag" for n in t.schema.names]), status={"flag": "only_left", "is_flag": "only_right"}),
        "precision_lost": Case(t, _set(_set(t, "created_at", [x.replace(microsecond=x.microsecond // 1000 * 1000) for x in t.column("created_at").to_pylist()], pa.timestamp("ms")), "amount", t.column("amount").to_pylist(), pa.decimal128(18, 2)), status={"created_at": "benign", "amount": "benign"}, identical=True),
        "timezone_utc": Case(t, _set(t, "created_at", utc, pa.timestamp("us", "UTC")), status={"created_at": "needs_tz"}, assume_tz="UTC"),
        "timezone_shifted": Case(t, _set(t, "created_at", utc, pa.timestamp("us", "UTC")), {"created_at": 200}, status={"created_at": "needs_tz"}, assume_tz="Europe/Berlin"),
        "timezone_unknown": Case(t, _set(t, "created_at", utc, pa.timestamp("us", "UTC")), status={"created_at": "needs_tz"}),
        "encoding_mangled": Case(t, _change(t, "name", lambda x: x.encode().decode("latin-1"), accented), {"name": len(accented)}),
        "nfc_equivalent": Case(t, _change(t, "name", lambda x: x and unicodedata.normalize("NFD", x), range(200)), identical=True),
        "duplicate_key": Case(t, pa.concat_tables([t, t.slice(5, 1)]), duplicate=True),
        "order_shuffled": Case(t, t.take(random.Random(1).sample(range(200), 200)), identical=True),
        "name_case_space": Case(t.rename_columns(["id", "User Name", *t.schema.names[2:]]), t.rename_columns(["id", "user_name", *t.schema.names[2:]]), status={"User Name": "only_left", "user_name": "only_right"}),
        "special_names": Case(odd, odd, identical=True),
        "case_colliding": Case(twice, _change(twice, "Delta", lambda x: x + 1, some[:3]), {"Delta": 3}),
        "long_strings": Case(long, _change(long, "long_text", lambda x: x + "!", some[:4]), {"long_text": 4}),
        "mostly_nulls": Case(sparse, _change(sparse, "sparse", lambda x: (x or 0) + 1, some[:3]), {"sparse": 3}),
        "nan_and_null": Case(t, _change(t, "score", lambda x: float("nan"), [i for i in some if scores[i] is not None]), {"score": sum(scores[i] is not None for i in some)}),
    }
