"""Parsers and rules for capture file names; all are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Positions by channel, channels of one kind, image suffixes, questions.
POSITIONS = {"1": "right top", "2": "left top", "3": "right bottom", "4": "left bottom", "5": "bottom center", "6": "bottom left", "7": "bottom right", "8": "trackside left", "9": "trackside right", "L5": "bottom center", "L3": "trackside", "L7": "trackside", "L4": "inner", "L6": "inner"}
UNDERCARRIAGE = ["5", "6", "7", "8", "9", "L3", "L4", "L5", "L6", "L7"]
WHEEL_CHANNELS = ["1", "2", "3", "4", "8", "9", "L1", "L2", "L3", "L7", "L8", "L9"]
SUFFIXES = ["jpg", "jpeg", "png", "ppm", "bmp", "pgm", "tif", "tiff", "webp"]
L_STATION = "NO_ROTATION_STATION_L"


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(SUFFIXES) + ")$")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def parse_capture(path: Column, dialect: str = "segmentation") -> Column:
    """A struct bureau, train_group, pass_time, station, row, car_seq, channel, pic_no, prefix, fmt; null if the name has
    no known form. The dialects differ in the L form; the training one also knows the ori form."""
    if dialect not in ("segmentation", "training"):
        raise ValueError(f"no dialect {dialect}")
    s = stem(path)
    p, n = F.split(s, "_"), F.size(F.split(s, "_"))
    at = lambda i: F.try_element_at(p, F.lit(i))
    num = lambda c: c.try_cast("int")
    nothing = F.lit(None).cast("string")
    fields = lambda bureau, group, time, station, row, car, channel, pic, prefix, fmt: F.struct(bureau.alias("bureau"), group.alias("train_group"), time.alias("pass_time"), station.alias("station"), row.alias("row"), car.cast("int").alias("car_seq"), channel.alias("channel"), pic.cast("int").alias("pic_no"), prefix.alias("prefix"), F.lit(fmt).alias("fmt"))
    is_l = at(-2).rlike(r"^L\d+$") & at(-1).rlike(r"^\d{4}$")
    if dialect == "segmentation":
        is_l = is_l & (n >= 7)
        l_form = fields(at(1), at(2), at(3), F.lit(L_STATION), at(5), F.lit(-1), at(6), num(at(7)), F.array_join(F.slice(p, 1, 6), "_"), "L")
    else:
        l_form = fields(at(1), at(2), at(3), F.lit(L_STATION), at(4), F.lit(-1), F.lit("0"), F.lit(-1), F.array_join(F.slice(p, 1, n - 1), "_"), "L")
    is_x = (n >= 7) & at(-2).rlike(r"^\d+$") & at(-1).rlike(r"^10X\d{4,}$")
    channel = F.substring(at(-1), 4, 1)
    x_form = fields(at(1), at(2), at(3), at(4), at(5), num(at(6)), channel, num(F.substring(at(-1), 5, 20)), F.concat(F.array_join(F.slice(p, 1, 6), "_"), F.lit("_10X"), channel), "10X")
    out = F.when(is_x, x_form)
    if dialect == "training":
        ori = r"_ori(\d{3})_(\d+)_([A-Z0-9]+)$"
        get = lambda i: F.regexp_extract(s, ori, i)
        o_form = fields(at(1), at(2), nothing, get(3), nothing, F.lit(-1), get(2), num(get(1)), F.regexp_replace(s, ori, ""), "ori")
        out = F.when(s.rlike(ori), o_form).otherwise(out)
    return F.when(is_l, l_form).otherwise(out)


def _first_match(name: Column, forms: list[str], keys: tuple[str, ...]) -> Column:
    out = None
    for f in forms:
        got = F.struct(*[F.regexp_extract(name, f, i).alias(k) for i, k in enumerate(keys, 1)])
        out = F.when(name.rlike(f), got) if out is None else out.when(name.rlike(f), got)
    return out


# The forms of target and background names, tried in order.
TARGET_FORMS = [r"^[^_]+_([^_]+)_(\d+)_[^_]+_\d+_\d+_10X(\d)_.*?_group\d+_(.+?)_image\.png$", r"^[^_]+_([^_]+)_(\d+)_[^_]+_\d+_(L\d+)_.*?_group\d+_(.+?)_image\.png$"]
BACKGROUND_FORMS = [r"^[^_]+_([^_]+)_(\d+)_[^_]+_\d+_\d+_10X(\d)", r"^[^_]+_([^_]+)_(\d+)_[^_]+_\d+_(L\d+)_\d{4}\.\w+$"]


def parse_target(name: Column) -> Column:
    """train_group, pass_time, channel, components of a target cut."""
    return _first_match(name, TARGET_FORMS, ("train_group", "pass_time", "channel", "components"))


def parse_background(name: Column) -> Column:
    """train_group, pass_time, channel of a background image."""
    return _first_match(name, BACKGROUND_FORMS, ("train_group", "pass_time", "channel"))


UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def parse_fault(name: Column) -> Column:
    form = rf"^([^_]+)_([^_]+)_({UUID})_(ori\d+)_(\d)_(.+)\.jpg$"
    return F.when(name.rlike(form), F.struct(*[F.regexp_extract(name, form, i).alias(k) for i, k in enumerate(("component", "fault_code", "alert_id", "ori", "channel", "location"), 1)]))


def parse_inference(name: Column) -> Column:
    form = r"^ori\d+_(\d)_(.+?)\.jpg$"
    return F.when(name.rlike(form), F.struct(F.regexp_extract(name, form, 1).alias("channel"), F.regexp_extract(name, form, 2).alias("station")))


def fault_path(path: Column, row_no: Column) -> Column:
    """alert_id, category and unit: the UUID in the path, and the folders above the first part that holds it."""
    parts, uuid = F.split(path, "/"), F.regexp_extract(path, UUID, 0)
    j = F.array_position(F.transform(parts, lambda x: x.contains(uuid)), True)
    part = lambda k: F.when(j > k, F.element_at(parts, (j - k).cast("int")))
    none = uuid == ""
    return F.struct(F.when(none, F.concat(F.lit("unknown_fault_"), row_no.cast("string"))).otherwise(uuid).alias("alert_id"), F.when(none, "unknown_category").otherwise(F.coalesce(part(1), F.lit("unknown_category"))).alias("category"), F.when(none, "unknown_unit").otherwise(F.coalesce(part(2), F.lit("unknown_unit"))).alias("unit"))


def time_word(pass_time: Column) -> Column:
    hour = F.substring(pass_time, 9, 2).try_cast("int")
    return F.when(hour.isNull(), "during the daytime").when((hour >= 5) & (hour < 12), "in the morning").when((hour >= 12) & (hour < 17), "in the afternoon").when((hour >= 17) & (hour < 21), "in the evening").otherwise("at night")


def position(channel: Column) -> Column:
    out = F.lit("an unknown position")
    for k, v in POSITIONS.items():
        out = F.when(channel == k, v).otherwise(out)
    return out


def location(channel: Column) -> Column:
    return F.when(channel.isin(UNDERCARRIAGE), "undercarriage").otherwise("side")


def train_type(train_group: Column) -> Column:
    return F.regexp_replace(train_group, r"-[^-]*$", "")


def component_words(raw: Column) -> Column:
    """Words of a component list; a name of two words becomes two."""
    return F.filter(F.split(F.trim(F.regexp_replace(raw, "_", " ")), r"\s+"), lambda w: w != "")


def prompt_components(words: Column, channel: Column, kind: Column) -> Column:
    """Wheel channels keep only wheels, or nothing; on CRH5 channels 5 and L5 an axle beside wheel and gearbox goes."""
    wheel = F.when(F.array_contains(words, "wheel"), F.array(F.lit("wheel"))).otherwise(F.array().cast("array<string>"))
    all3 = F.array_contains(words, "axle") & F.array_contains(words, "wheel") & F.array_contains(words, "gearbox")
    crh5 = kind.startswith("CRH5") & channel.isin("5", "L5") & all3
    return F.when(channel.isin(WHEEL_CHANNELS), wheel).when(crh5, F.array_remove(words, "axle")).otherwise(words)


def group_name(classes: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(classes)), "_")


def bool_flag(s: Column) -> Column:
    low = F.lower(s)
    return F.when(low.isin("off", "false", "0"), False).when(low.isin("on", "true", "1"), True).otherwise(F.raise_error(F.concat(F.lit("invalid value for a boolean flag: "), F.coalesce(s, F.lit("null")))).cast("boolean"))


def rotation_keys(channel: Column, station: Column) -> tuple[Column, Column]:
    """The exact and the fallback key of the rotation table."""
    low = channel.isin("1", "2", "3", "4")
    high = channel.isin("5", "6", "7", "8", "9")
    exact = F.when(low, F.concat(station, F.lit("_1"))).when(high, F.concat(station, F.lit("_"), channel))
    return exact, F.when(high, F.concat(station, F.lit("_5")))


def needs_rotation(path: Column, flag: Column, folder: str) -> Column:
    """The rotation flag, and every image of a special folder."""
    return path.contains(folder) | flag
