"""Image-text records: four kinds of prompts, joins with fault records, and their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwise.functions import captures as C

QUESTIONS = ["Describe this image.", "What does this image show?", "Explain what can be seen in this picture."]


def target_prompts(df: DataFrame) -> DataFrame:
    """path, train_group, pass_time, channel, components to path, prompt; rows whose components all go are dropped."""
    kind, words = C.train_type(F.col("train_group")), C.component_words(F.col("components"))
    df = df.withColumn("__w", C.prompt_components(words, F.col("channel"), kind)).where(F.size("__w") > 0)
    text = F.concat(F.lit("A photo of a train's "), C.location(F.col("channel")), F.lit(", showing "), F.array_join("__w", " "), F.lit(" at the "), C.position(F.col("channel")), F.lit(" of a "), kind, F.lit(" train "), C.time_word(F.col("pass_time")), F.lit("."))
    return df.select("path", text.alias("prompt"))


def background_prompts(df: DataFrame) -> DataFrame:
    kind = C.train_type(F.col("train_group"))
    text = F.concat(F.lit("A background view from the "), C.position(F.col("channel")), F.lit(" of a "), kind, F.lit(" train's "), C.location(F.col("channel")), F.lit(" "), C.time_word(F.col("pass_time")), F.lit(", with no key components visible."))
    return df.select("path", text.alias("prompt"))


def manual_prompts(df: DataFrame) -> DataFrame:
    """Components come from the folder name."""
    kind, words = C.train_type(F.col("train_group")), F.array_join(C.component_words(F.col("folder")), " ")
    text = F.concat(F.lit("A photo of a train's "), C.location(F.col("channel")), F.lit(", showing "), words, F.lit(" at the "), C.position(F.col("channel")), F.lit(" of a "), kind, F.lit(" train "), C.time_word(F.col("pass_time")), F.lit("."))
    return df.select("path", text.alias("prompt"))


def longest_prefix(df: DataFrame, code: str, dictionary: DataFrame, key: str, name: str, default: str = "unknown component") -> DataFrame:
    """name of the longest dictionary key that begins the code: all prefixes of distinct codes, hashed to the keys."""
    codes = df.select(F.col(code).alias("__c")).distinct()
    prefixes = codes.select("__c", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("__c"), F.lit(1))), lambda i: F.substring("__c", F.lit(1), i))).alias("__p"))
    hit = prefixes.join(dictionary.select(F.col(key).alias("__p"), F.col(name).alias("__n")), "__p").groupBy("__c").agg(F.max_by("__n", F.length("__p")).alias("component"))
    return df.join(hit, F.col(code) == F.col("__c"), "left").drop("__c").withColumn("component", F.coalesce("component", F.lit(default)))


def fault_prompts(images: DataFrame, faults: DataFrame, components: DataFrame, translations: DataFrame) -> DataFrame:
    """images: alert_id, path, channel; faults: ALERTID, SETNO, TIME, TYPECODE, ALARMCODE; components: code, component_name;
    translations: alarm, english. Images of one alert are one record; alerts without a fault record are dropped."""
    from .reports import grouped_images

    g = grouped_images(images, "alert_id", "path", "channel")
    df = g.join(faults, g.alert_id == faults.ALERTID).join(translations, F.col("ALARMCODE") == F.col("alarm"), "left")
    df = longest_prefix(df, "TYPECODE", components, "code", "component_name")
    english = F.coalesce("english", F.lit("an unspecified issue"))
    text = F.concat(F.lit("A photo of a train's "), C.location(F.col("channel")), F.lit(' showing a "'), english, F.lit('" fault on a '), F.col("component"), F.lit(", viewed from the "), C.position(F.col("channel")), F.lit(" of a "), C.train_type(F.col("SETNO")), F.lit(" train "), C.time_word(F.col("TIME")), F.lit("."))
    return df.select("images", text.alias("prompt"))


def record(images: Column, prompt: Column, base: str = "") -> tuple[Column, Column, Column]:
    """image, images and conversations of a training record; the question hangs on the path. Paths must be under base."""
    cut = F.transform(images, lambda p: F.when(p.startswith(base), F.substring(p, F.lit(len(base) + 1), F.length(p))).otherwise(F.raise_error(F.concat(F.lit("not under the base folder: "), p))))
    one = F.size(images) == 1
    ask = F.when(one, F.get(F.array(*map(F.lit, QUESTIONS)), (F.conv(F.substring(F.md5(images[0]), 1, 8), 16, 10).cast("long") % len(QUESTIONS)).cast("int"))).otherwise(F.concat(F.array_join(F.array_repeat(F.lit("<image>"), F.size(images)), "\n"), F.lit("\nDescribe these images.")))
    talk = F.array(F.struct(F.lit("human").alias("from"), ask.alias("value")), F.struct(F.lit("gpt").alias("from"), prompt.alias("value")))
    return F.when(one, cut[0]).alias("image"), F.when(~one, cut).alias("images"), talk.alias("conversations")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A reproducible order."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)
