"""Logical input tables of the registered queries, derived from the given parquet files.

Every table is an expression over whole given tables; none is cut to make a
check cheap. The oracle SQL derives the same tables with the same expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.ledger import normalize_transaction_type


SPREAD = "spark.lexiloom.spreadTexts"


class Tables:
    """The given parquet folder as the library's logical tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def texts(self, name: str) -> DataFrame:
        """A table of texts as it is read, or dealt out to as many tasks as the session asks for with `SPREAD`.

        Text work is heavy per row, so a small file with a single row group would
        keep one core busy. Nothing is dealt out unless the session says so.
        """
        tasks = self.spark.conf.get(SPREAD, None)
        return self.given(name).repartition(int(tasks)) if tasks else self.given(name)

    # --- ledger ---------------------------------------------------------------
    def users(self) -> DataFrame:
        """Customers that do not owe anything; so some movements have no user."""
        key = F.col("c_custkey")
        return self.given("customer").filter("c_acctbal >= 0").select(
            key.alias("user_id"),
            F.col("c_name").alias("username"),
            _text("u", key, "@example.com").alias("email"),
            F.md5("c_name").alias("password"),
            _clock("2024-01-01").alias("created_at"),
            (key % 7 != 0).alias("is_active"),
            F.lit(5000).cast("long").alias("credits"),
            (F.col("c_nationkey") % 3).cast("string").alias("account_type"),
        )

    def transactions(self) -> DataFrame:
        kind = normalize_transaction_type(F.col("event_type"))
        return self.given("events").select(
            F.col("event_id").alias("id"),
            "user_id",
            F.col("value").cast("decimal(10,2)").alias("amount"),
            kind.alias("transaction_type"),
            F.col("ts").alias("created_at"),
            F.when(kind == "purchase", "bank").alias("payment_method"),
        )

    def history(self) -> DataFrame:
        key = F.col("doc_id")
        return self.texts("documents").select(
            key.alias("id"),
            (key % 150).alias("user_id"),
            F.col("text").alias("input_text"),
            F.concat(F.lit("> "), F.col("text")).alias("output_text"),
            F.col("lang").alias("source_language"),
            F.when(key % 3 == 0, "vi").when(key % 3 == 1, "en").otherwise("ja").alias("target_language"),
            (_clock("2024-01-01") + F.make_dt_interval(mins=key.cast("int"))).alias("created_at"),
        )

    def payments(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.given("orders").select(
            F.col("o_orderkey").alias("order_code"),
            F.col("o_custkey").alias("user_id"),
            F.floor("o_totalprice").cast("int").alias("amount"),
            F.when(status == "F", "PAID").when(status == "O", "PENDING").otherwise("CANCELLED").alias("status"),
        )

    def history_changes(self) -> DataFrame:
        """A feed with delete requests among other changes: some fit, some come from a stranger, some name no row."""
        key = F.col("event_id")
        return self.given("events").select(
            key.alias("seq"),
            F.when(F.col("event_type") == "error", "delete").otherwise(F.col("event_type")).alias("action"),
            (F.col("user_id") + 150 * (key % 8) + F.when(key % 3 == 0, 1).otherwise(0)).alias("history_id"),
            "user_id",
            F.col("ts"),
        )

    def user_changes(self) -> DataFrame:
        key, kind, amount = F.col("event_id"), F.col("event_type"), F.floor("value")
        action = F.when(kind == "error", "role").when(kind == "signup", "active").when(kind == "click", "add").when(
            kind == "view", "subtract"
        )
        value = F.when(kind == "error", key % 4).when(kind == "signup", key % 3).otherwise(amount.cast("long") - 5)
        return self.given("events").select(
            key.alias("seq"), "user_id", action.otherwise("delete").alias("action"), value.cast("string").alias("value")
        )

    def profile_changes(self) -> DataFrame:
        key, kind = F.col("event_id"), F.col("event_type")
        gone = (kind == "error") & (F.col("value") > 300)
        return self.given("events").select(
            key.alias("seq"),
            "user_id",
            F.when(gone, "delete").otherwise("patch").alias("action"),
            F.when(kind == "click", _text("name", key)).when(kind == "view", "").alias("username"),
            F.when(kind == "view", _text("e", key, "@example.org")).alias("email"),
        )

    def config(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.given("supplier").filter("s_acctbal >= 1000").select(
            key.alias("id"),
            F.col("s_name").alias("name_web"),
            F.floor("s_acctbal").cast("int").alias("price"),
            _text("s", key, "@example.com").alias("email"),
        )

    def config_patch(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.given("supplier").select(
            key.alias("id"),
            F.when(key % 2 == 0, F.upper("s_name")).alias("name_web"),
            F.when(key % 3 == 0, 100).alias("price"),
            F.lit(None).cast("string").alias("email"),
        )

    def signups(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.given("orders").select(
            key.alias("seq"),
            F.when(key % 4 == 0, F.format_string("Customer#%09d", F.col("o_custkey")))
            .otherwise(_text("new", key % 5000))
            .alias("username"),
            _text("u", F.col("o_custkey") * 3 + key % 3, "@example.com").alias("email"),
        )

    # --- documents --------------------------------------------------------------
    def segments(self) -> DataFrame:
        return self.texts("documents").select(
            "doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("para_idx", "text")
        )

    def runs(self, dealt: bool = False, whole: bool = False) -> DataFrame:
        """Two lines make a paragraph; a run is a word with the blank after it.

        With `dealt`, whole texts go to tasks by document before they are cut. Spark
        knows that then, and work on documents and paragraphs shuffles no words.
        With `whole`, a row is a paragraph with the texts of its runs in order.
        """
        lines = F.split("text", "\n", -1)
        pairs = F.transform(
            F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / 2).cast("int")),
            lambda p: F.array_join(F.slice("_lines", p * 2 + 1, F.lit(2)), "\n"),
        )
        number, para = F.col("doc_id"), F.col("para_idx")
        part = F.when(para % 10 == 9, "footer1.xml").when((number % 5 == 0) & (para == 0), "header1.xml").otherwise(
            "document.xml"
        )
        texts = self.texts("documents").select("doc_id", number.cast("string").alias("doc"), "text")
        paragraphs = (
            (texts.repartition("doc") if dealt else texts)
            .select("doc_id", "doc", lines.alias("_lines"))
            .select("doc_id", "doc", F.posexplode(pairs).alias("para_idx", "_para"))
            .withColumn("part", part)
        )
        words = F.split("_para", "(?<= )", -1)
        if whole:
            return paragraphs.filter("_para IS NOT NULL").select("doc", "part", "para_idx", words.alias("texts"))
        return paragraphs.select("doc", "part", "para_idx", F.posexplode(words).alias("run_idx", "text")).select(
            "doc",
            "part",
            F.regexp_replace("part", r"1?\.xml$", "").alias("part_kind"),
            "para_idx",
            "run_idx",
            F.lit(0).alias("text_idx"),
            "text",
        )

    @staticmethod
    def with_targets(segments: DataFrame) -> DataFrame:
        """Stand-in translations: the same lines, one line only, or more lines; none for every seventh document."""
        number, para, source = F.col("doc").cast("long"), F.col("para_idx"), F.col("source")
        target = (
            F.when(number % 7 == 0, F.lit(None).cast("string"))
            .when(para % 3 == 0, F.replace(source, F.lit(" "), F.lit("_")))
            .when(para % 3 == 1, F.replace(source, F.lit("\n"), F.lit(" ")))
            .otherwise(F.concat(F.lit("first\n"), source, F.lit("\nlast")))
        )
        return segments.withColumn("target", F.when(F.col("translate"), target))

    def page_texts(self) -> DataFrame:
        return self.texts("pages").select(
            "page_id", F.concat(F.lit("see "), "url", _text(" or mail p", F.col("page_id"), "@example.org now "), "html").alias("text")
        )

    def requests(self) -> DataFrame:
        key, t = F.col("doc_id"), F.col("text")
        kind = key % 6
        question = (
            F.when(kind == 0, F.concat(F.lit("TRANSLATE|"), "lang", F.lit("|vi|General|"), t, F.lit("|tail")))
            .when(kind == 1, F.concat(F.lit("ANALYZE|"), t))
            .when(kind == 2, _text("TRANSCRIBE|audio_", key, ".mp3|"))
            .when(kind == 3, _text("TRANSLATE_DOCX|in_", key, ".docx|out.docx|ja|m1|0.5|8"))
            .when(kind == 4, F.concat(F.lit("TRANSLATE|"), "lang"))
            .otherwise(F.concat(F.lit("UNKNOWN|"), t))
        )
        return self.texts("documents").select(key.alias("id"), question.alias("question"))

    def replies(self) -> DataFrame:
        key = F.col("conv_id") * 1_000_000 + F.col("turn")
        t = F.regexp_replace("text", "[^A-Za-z ]", "")
        whole = F.concat(
            F.lit('{"language":[{"name":"'), "role", F.lit('","code":"en","text":"'), t, F.lit('"},{"text":"x"}]}')
        )
        broken = F.concat(F.lit('{"language":[{"name":"'), t)
        return self.given("conversations").select(
            key.alias("id"), F.when(key % 7 == 0, broken).otherwise(whole).alias("reply")
        )

    def open_messages(self) -> DataFrame:
        """A message per turn as JSON with fields that come, go and change their type; some are cut off, some are no objects."""
        turn, conv = F.col("turn"), F.col("conv_id")

        def quoted(name: str) -> Column:
            inside = F.to_json(F.struct(F.col(name).alias("x")))
            return F.when(F.col(name).isNull(), "null").otherwise(inside.substr(F.lit(6), F.length(inside) - 6))

        length = F.length("text").cast("string")
        whole = F.concat(
            F.lit('{"status":'), quoted("role"), F.lit(',"length":'), F.when(turn % 4 == 3, F.concat(F.lit('"'), length, F.lit('"'))).otherwise(length),
            F.when(turn % 3 == 0, ',"note":null').when(turn % 2 == 0, F.concat(F.lit(',"note":'), quoted("text"))).otherwise(""),
            F.when(turn % 5 == 1, F.concat(F.lit(',"extra_'), (conv % 7).cast("string"), F.lit('":{"done":'), (turn % 2 == 0).cast("string"), F.lit(',"marks":['), turn.cast("string"), F.lit(',"x"]}'))).otherwise(""),
            F.lit("}"),
        )
        body = (
            F.when(turn % 13 == 12, F.concat(F.lit("["), turn.cast("string"), F.lit("]")))
            .when((conv % 11 == 3) & (turn % 4 == 1), whole.substr(F.lit(1), F.length(whole) - 1))
            .otherwise(whole)
        )
        return self.given("conversations").select(conv.alias("job_id"), turn.alias("seq"), body.alias("body"))

    def model_outputs(self) -> DataFrame:
        key = F.col("doc_id") * 10_000_000 + F.col("para_idx")
        t = F.col("text")
        output = (
            F.when(key % 13 == 0, F.concat(F.lit("I'm sorry, "), t))
            .when(key % 11 == 0, "EMPTY")
            .when(key % 7 == 0, F.concat(F.lit("Translation: "), t))
            .when(key % 5 == 0, "There is no text to translate")
            .otherwise(F.concat(F.lit("> "), t))
        )
        return self.segments().select(key.alias("id"), t.alias("source"), output.alias("output"))

    def memory(self, target_lang: str = "vi", style: str = "General") -> DataFrame:
        """What was translated before: the lines of the French documents."""
        return (
            self.segments()
            .filter("lang = 'fr'")
            .groupBy(F.md5("text").alias("key"), F.col("text").alias("source"))
            .agg(F.max("doc_id").alias("_last"))
            .select(
                "key",
                F.lit(target_lang).alias("target_lang"),
                F.lit(style).alias("style"),
                "source",
                F.concat(F.lit("vi:"), "source").alias("target"),
                (_clock("2024-01-01") + F.make_dt_interval(mins=F.col("_last").cast("int"))).alias("last_used"),
            )
        )

    # --- OCR --------------------------------------------------------------------
    def images(self) -> DataFrame:
        key = F.col("image_id")
        # Distinct keys first: the sizes follow from them, and joins by image reuse the shuffle.
        keys = self.given("lineitem").select(F.col("l_orderkey").alias("image_id")).distinct()
        return keys.select(
            key, (300 + key % 400).cast("int").alias("width"), (200 + key % 700).cast("int").alias("height")
        )

    def boxes(self) -> DataFrame:
        """`idx` orders the lines of an order; it is made of their columns, so it needs no sort."""
        cents = F.round(F.col("l_extendedprice") * 100).cast("long")
        padded = lambda value, width: F.lpad(value.cast("string"), width, "0")
        idx = F.concat(padded(F.col("l_linenumber"), 2), padded(F.col("l_partkey"), 14), padded(F.col("l_suppkey"), 13), padded(cents, 14))
        left = (F.col("l_partkey") % 400 - 10).cast("int")
        top = ((F.col("l_suppkey") % 10) * 6 - 4).cast("int")
        # Joins ask for a known image anyway; saying so here lets all uses of the boxes share one shuffle.
        return self.given("lineitem").filter("l_orderkey IS NOT NULL").select(
            F.col("l_orderkey").alias("image_id"),
            idx.alias("idx"),
            left.alias("x_min"),
            top.alias("y_min"),
            (left + 20 + F.col("l_quantity").cast("int")).alias("x_max"),
            (top + 10 + F.col("l_linenumber")).alias("y_max"),
            _text("w", F.col("l_partkey")).alias("text"),
            (1 - F.col("l_discount")).cast("decimal(4,2)").cast("double").alias("confidence"),
        )

    def free_boxes(self) -> DataFrame:
        corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
        corners = F.array(corner("x_min", "y_min"), corner("x_max", "y_min"), corner("x_max", "y_max"), corner("x_min", "y_max"))
        return self.boxes().filter("x_max % 2 <> 0").select("image_id", "idx", "text", corners.alias("pts"))

    def manifest_lines(self) -> DataFrame:
        """Lines of a text-area manifest; some are short or hold no number."""
        quantity = F.col("l_quantity")
        box = F.concat_ws(",", *[c.cast("string") for c in (F.col("l_partkey"), F.col("l_suppkey"), F.col("l_partkey") + 40, F.col("l_suppkey") + 12)])
        head = F.concat_ws("|", F.col("l_linenumber").cast("string"), box, _text("w", F.col("l_partkey")))
        line = (
            F.when(quantity == 1, F.concat(head, F.lit("|n/a")))
            .when(quantity == 2, head)
            .otherwise(F.concat(head, F.lit("|"), (100 - F.col("l_linenumber")).cast("string")))
        )
        return self.texts("lineitem").select(F.col("l_orderkey").alias("image_id"), line.alias("value"))

    def media(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        suffix = F.when(size % 5 == 0, ".MP3").when(size % 5 == 1, ".wav").when(size % 5 == 2, ".txt").when(size % 5 == 3, ".png")
        return self.given("part").select(
            F.concat(_text("media/", key, "/crop_"), (key * 7 % 1000).cast("string"), suffix.otherwise(".jpg")).alias("path"),
            F.when(size == 1, 0).otherwise(size * 1024 * 1024).cast("long").alias("length"),
        )

    # --- ordered events -----------------------------------------------------------
    def cache_requests(self) -> DataFrame:
        """Keys too large for a double, and missing ones."""
        return self.given("events").select(
            F.col("event_id").alias("id"),
            F.when(F.col("user_id") % 10 != 9, F.col("user_id") % 10 + 2**53).alias("key"),
            "ts",
            (F.col("value") >= 5).alias("storable"),
        )

    def credit_events(self) -> DataFrame:
        """Some movements have no amount."""
        return self.given("events").select(
            F.col("event_id").alias("seq"),
            "user_id",
            "ts",
            F.when(F.col("event_type") == "purchase", "add").otherwise("subtract").alias("kind"),
            F.when(F.col("event_id") % 13 != 0, (F.floor("value") * 20).cast("long")).alias("amount"),
        )

    def status_events(self) -> DataFrame:
        key, left = F.col("event_id"), F.floor("value").cast("long")
        present = F.array(*[F.lit(c) for c in ("status", "current", "total", "started_at")])
        return self.given("events").select(
            F.col("user_id").alias("job_id"),
            key.alias("seq"),
            "ts",
            F.when(left == 0, "completed").otherwise("processing").alias("status"),
            (F.unix_date(F.col("ts").cast("date")).cast("double") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60).alias(
                "started_at"
            ),
            key.alias("current"),
            (key + left).alias("total"),
            F.when(key % 5 != 0, F.col("event_type")).alias("message"),
            F.when(key % 3 != 0, F.concat(present, F.array(F.lit("message")))).otherwise(present).alias("present"),
        )

    # --- retrieval ------------------------------------------------------------------
    def corpus(self) -> DataFrame:
        return self.given("embeddings")

    def label_queries(self) -> DataFrame:
        """One query per label: the mean vector of its members."""
        return (
            self.corpus()
            .select("label", F.posexplode("embedding").alias("_i", "_v"))
            .groupBy("label", "_i")
            .agg(F.avg(F.col("_v").cast("double")).alias("_v"))
            .groupBy(F.col("label").alias("query_id"))
            .agg(F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("_a"))
            .select("query_id", F.transform("_a", lambda a: a["_v"]).alias("embedding"))
        )


def _clock(text: str) -> Column:
    return F.lit(f"{text} 00:00:00").cast("timestamp_ntz")


def _text(before: str, value: Column, after: str = "") -> Column:
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))
