"""Sources over files: weather reports (CSV), feeds (XML), news items (JSON) and folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.errors import SourceError
from vertexloom.schema import Schema
from vertexloom.sources.sdl import schema_sdl, vertex_sdl
from vertexloom.sources.spec import Get, Source

# weather

WEATHER_SDL = schema_sdl(
    "LatestMetarReportForAirport(airport_code: String!): MetarReport MetarReport: [MetarReport]",
    vertex_sdl(
        "MetarReport",
        String="raw_report station_id",
        Float="altimeter_in_hg? dewpoint? latitude? longitude? sea_level_pressure_mb? temperature? visibility_statute_mi?",
        Int="wind_direction? wind_gusts_kts? wind_speed_kts?",
        Boolean="visibility_minimal? visibility_unlimited? wind_direction_variable?",
        edges="cloud_cover: [MetarCloudCover!]",
    ),
    vertex_sdl("MetarCloudCover", Int="base_altitude?", String="sky_cover"),
)
_FLAGS = "corrected auto auto_station maintenance_indicator_on no_signal lightning_sensor_off freezing_rain_sensor_off present_weather_sensor_off"
#: Columns by position, for the file repeats some names in its header.
METAR_COLUMNS = (
    "raw_text station_id observation_time latitude longitude temp_c dewpoint_c wind_dir_degrees wind_speed_kt wind_gust_kt visibility_statute_mi "
    f"altim_in_hg sea_level_pressure_mb {_FLAGS} wx_string " + " ".join(f"sky_cover_{i} cloud_base_ft_agl_{i}" for i in range(1, 5)) + " flight_category "
    "three_hr_pressure_tendency_mb max_t_c min_t_c max_t24hr_c min_t24hr_c precip_in pcp3hr_in pcp6hr_in pcp24hr_in snow_in vert_vis_ft metar_type elevation_m"
).split()
_HEADER = ["sky_cover" if c.startswith("sky_cover") else "cloud_base_ft_agl" if c.startswith("cloud_base") else c for c in METAR_COLUMNS]
_SOME, _UNIT = "[0-9/]", "(?:KT|MPS|KPH)?"
_WIND = f"(?:(?://///|(?:{_SOME}{{3}}|VRB){_SOME}{{2}}(?:G{_SOME}{{2}})?{_UNIT}) )?(?:{_SOME}{{3}}V{_SOME}{{3}} )?"
_SIGHT = rf"[A-Z]{{4}} [0-9]{{6}}Z (?:AUTO )?{_WIND}(CAVOK|[0-9]{{4}}|[0-9/ ]+SM) "
_METRES_A_MILE = 1609.344


def weather_source(spark: SparkSession, path: str | DataFrame, check_header: bool = True) -> Source:
    """Reports of a METAR file, or of rows with its columns; lines of stations without a report ("AUTO NIL") are left out."""
    if check_header and isinstance(path, str):
        found = [c.strip().lower() for c in _first_line(spark, path).split(",")]
        if len(found) != len(_HEADER) or found[:7] != [c.lower() for c in _HEADER[:7]]:
            raise SourceError("UnexpectedHeader", path, found)
    raw = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in METAR_COLUMNS), enforceSchema=True, escape='"') if isinstance(path, str) else path
    raw = raw.where(~F.col("raw_text").contains("AUTO NIL"))

    def number(column: str, kind: str = "double"):
        return lambda get: get(column).try_cast(kind)

    def seen(get: Get) -> Column:
        return F.nullif(F.regexp_extract(get("raw_text"), _SIGHT, 1), F.lit(""))

    def miles(get: Get) -> Column:
        text = F.trim(F.regexp_replace(seen(get), "SM$", ""))
        parts = F.split(text, "[ /]")
        n = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
        of = F.when(text.rlike("^[0-9]+ [0-9]+/[0-9]+$"), n(1) + n(2) / n(3)).when(text.rlike("^[0-9]+/[0-9]+$"), n(1) / n(2)).otherwise(text.try_cast("double"))
        metres = F.when(text.rlike("^[0-9]{4}$") & ~text.isin("9999", "0000"), text.try_cast("double") / _METRES_A_MILE)
        return F.when(seen(get).endswith("SM"), of).otherwise(metres)

    def layers(get: Get) -> Column:
        all_ = F.array(*[F.struct(get(f"sky_cover_{i}").alias("sky_cover"), get(f"cloud_base_ft_agl_{i}").try_cast("bigint").alias("base_altitude")) for i in range(1, 5)])
        return F.filter(all_, lambda x: x["sky_cover"].isNotNull())

    known = lambda get: miles(get).isNotNull() | seen(get).isin("9999", "0000", "CAVOK")
    direction = "wind_dir_degrees"
    s = Source(spark, Schema(WEATHER_SDL))
    s.vertex(
        "MetarReport",
        raw,
        {
            "raw_report": "raw_text",
            "latitude": number("latitude"),
            "longitude": number("longitude"),
            "wind_speed_kts": number("wind_speed_kt", "bigint"),
            "wind_gusts_kts": number("wind_gust_kt", "bigint"),
            "wind_direction": number(direction, "bigint"),
            "wind_direction_variable": lambda get: F.when(get(direction) == "VRB", True).when(get(direction).try_cast("bigint").isNotNull(), False),
            "temperature": number("temp_c"),
            "dewpoint": number("dewpoint_c"),
            "altimeter_in_hg": number("altim_in_hg"),
            "sea_level_pressure_mb": number("sea_level_pressure_mb"),
            "visibility_statute_mi": miles,
            "visibility_unlimited": lambda get: F.when(known(get), seen(get).isin("9999", "CAVOK")),
            "visibility_minimal": lambda get: F.when(known(get), seen(get) == "0000"),
        },
        order=["station_id", "observation_time"],
    )
    s.vertex("MetarCloudCover", spark.createDataFrame([], "sky_cover string, base_altitude bigint"))
    s.root("MetarReport")
    s.root("LatestMetarReportForAirport", lambda raw, airport_code: raw.where(raw["station_id"] == airport_code).orderBy(F.desc("observation_time")).limit(1))
    s.edge_array("MetarReport", "cloud_cover", layers, ["sky_cover_1", "cloud_base_ft_agl_1", "sky_cover_2", "cloud_base_ft_agl_2", "sky_cover_3", "cloud_base_ft_agl_3", "sky_cover_4", "cloud_base_ft_agl_4"])
    return s


# feeds

FEEDS_SDL = schema_sdl(
    "FeedAtUrl(url: String!): Feed Feed: [Feed!]!",
    vertex_sdl("Feed", String="feed_type id language?", Int="ttl?", edges="entries: [FeedEntry] links: [FeedLink] logo: ChannelImage title: FeedText rights: FeedText description: FeedText"),
    vertex_sdl("FeedText", String="content content_type src?"),
    vertex_sdl("FeedEntry", String="source? id", edges="summary: FeedText title: FeedText rights: FeedText links: [FeedLink] content: FeedContent"),
    vertex_sdl("FeedContent", Int="length?", String="content_type body?"),
    vertex_sdl("FeedLink", Int="length?", String="title? rel? media_type? href_lang? href"),
    vertex_sdl("ChannelImage", String="title? uri description?", Int="height? width?"),
)
_TEXT = "struct<_VALUE:string,_type:string,_src:string>"
_LINKS = "array<struct<_VALUE:string,_href:string,_rel:string,_type:string,_hreflang:string,_title:string,_length:bigint>>"
_ENTRY = f"struct<id:string,guid:string,title:{_TEXT},summary:{_TEXT},description:{_TEXT},rights:{_TEXT},content:{_TEXT},link:{_LINKS},source:string>"
_IMAGE = "struct<url:string,title:string,description:string,width:bigint,height:bigint>"
_BODY = f"id string, language string, ttl bigint, title {_TEXT}, subtitle {_TEXT}, description {_TEXT}, rights {_TEXT}, copyright {_TEXT}, logo string, image {_IMAGE}, link {_LINKS}, entry array<{_ENTRY}>, item array<{_ENTRY}>"


def feeds_source(spark: SparkSession, *paths: str, documents: DataFrame | None = None) -> Source:
    """Atom (``feed``) and RSS (``channel``) documents; the file's path is a feed's address.

    ``documents`` are (url, xml), each holding one ``feed`` or one ``channel`` element, in place of files.
    """

    def of(tag: str, kind: str) -> DataFrame:
        if documents is not None:
            element = F.regexp_extract("xml", f"(?s)<{tag}[\\s>].*</{tag}>", 0)
            return documents.where(element != "").select(F.from_xml(element, _BODY).alias("x"), "url").select("x.*", F.lit(kind).alias("feed_type"), "url")
        return spark.read.format("xml").option("rowTag", tag).schema(_BODY).load(list(paths)).select("*", F.lit(kind).alias("feed_type"), F.col("_metadata.file_path").alias("url"))

    raw = of("feed", "Atom").unionByName(of("channel", "RSS"))
    text = lambda x: F.struct(x["_VALUE"].alias("content"), F.coalesce(x["_type"], F.lit("text/plain")).alias("content_type"), x["_src"].alias("src"))
    some = lambda x: F.filter(F.array(x), lambda e: e["content"].isNotNull())
    links = lambda x: F.transform(x, lambda e: F.struct(F.coalesce(e["_href"], e["_VALUE"]).alias("href"), e["_rel"].alias("rel"), e["_type"].alias("media_type"), e["_hreflang"].alias("href_lang"), e["_title"].alias("title"), e["_length"].alias("length")))
    s = Source(spark, Schema(FEEDS_SDL))
    s.vertex("Feed", raw, {"id": lambda get: F.coalesce(get("id"), F.element_at(F.transform(get("link"), lambda e: F.coalesce(e["_href"], e["_VALUE"])), 1), get("url"))})
    s.vertex("FeedEntry", spark.createDataFrame([], _BODY.split(", entry")[0].replace("ttl bigint, ", "") + ", guid string, summary " + _TEXT + ", content " + _TEXT + ", source string"), {"id": lambda get: F.coalesce(get("id"), get("guid"))})
    for name, columns in {"FeedText": "content string, content_type string, src string", "FeedContent": "body string, content_type string, length bigint", "FeedLink": "href string, rel string, media_type string, href_lang string, title string, length bigint", "ChannelImage": "uri string, title string, description string, width bigint, height bigint"}.items():
        s.vertex(name, spark.createDataFrame([], columns))
    s.root("Feed")
    s.root("FeedAtUrl", lambda raw, url: raw.where(raw["url"] == url))
    s.edge_array("Feed", "entries", lambda get: F.coalesce(get("entry"), get("item")), ["entry", "item"])
    s.edge_array(["Feed", "FeedEntry"], "links", lambda get: links(get("link")), ["link"])
    s.edge_array("Feed", "title", lambda get: some(text(get("title"))), ["title"])
    s.edge_array("FeedEntry", "title", lambda get: some(text(get("title"))), ["title"])
    s.edge_array("Feed", "description", lambda get: some(text(F.coalesce(get("subtitle"), get("description")))), ["subtitle", "description"])
    s.edge_array("FeedEntry", "summary", lambda get: some(text(F.coalesce(get("summary"), get("description")))), ["summary", "description"])
    s.edge_array("Feed", "rights", lambda get: some(text(F.coalesce(get("rights"), get("copyright")))), ["rights", "copyright"])
    s.edge_array("FeedEntry", "rights", lambda get: some(text(get("rights"))), ["rights"])
    body = lambda x: F.filter(F.array(F.struct(x["_VALUE"].alias("body"), F.coalesce(x["_type"], F.lit("text/plain")).alias("content_type"), F.octet_length(x["_VALUE"]).cast("long").alias("length"))), lambda e: e["body"].isNotNull())
    s.edge_array("FeedEntry", "content", lambda get: body(get("content")), ["content"])
    image = lambda get: F.array(F.struct(F.coalesce(get("image")["url"], get("logo")).alias("uri"), get("image")["title"].alias("title"), get("image")["description"].alias("description"), get("image")["width"].alias("width"), get("image")["height"].alias("height")))
    s.edge_array("Feed", "logo", lambda get: F.filter(image(get), lambda e: e["uri"].isNotNull()), ["image", "logo"])
    return s


# news items

_ITEM = {"Int": "unixTime id", "String": "url"}
NEWS_SDL = schema_sdl(
    "Latest(max: Int): [Story!]! Top(max: Int): [Item!]! User(name: String!): User FrontPage: [Item!]!",
    vertex_sdl("Item", interface=True, **_ITEM),
    vertex_sdl("Job", "Item", Int="score unixTime id", String="title url"),
    vertex_sdl("Story", "Item", Int="commentsCount score unixTime id", String="title url byUsername submittedUrl? text?", edges="comment: [Comment!] byUser: User!"),
    vertex_sdl("Comment", "Item", Int="childCount unixTime id", String="byUsername url text", edges="parent: Item! reply: [Comment!] byUser: User!"),
    vertex_sdl("Poll", "Item", **_ITEM),
    vertex_sdl("PollOption", "Item", **_ITEM),
    vertex_sdl("User", String="about? id", Int="unixCreatedAt delay? karma", edges="submitted: [Item!]"),
)
_ITEM_COLUMNS = "id bigint, type string, time bigint, by string, title string, text string, url string, score bigint, descendants bigint, kids array<bigint>, parent bigint, rank bigint, deleted boolean, dead boolean"
_USER_COLUMNS = "id string, karma bigint, about string, created bigint, delay bigint, submitted array<bigint>"
_FRONT = 30


def news_source(spark: SparkSession, items: str | DataFrame, users: str | DataFrame, site: str = "https://example.com/item?id=") -> Source:
    """A snapshot of a news site: JSON lines of items (``rank`` is the place on the front page) and of users."""
    items = spark.read.schema(_ITEM_COLUMNS).json(items) if isinstance(items, str) else items
    users = spark.read.schema(_USER_COLUMNS).json(users) if isinstance(users, str) else users
    items = items.where("id IS NOT NULL AND type IS NOT NULL AND NOT coalesce(deleted, false) AND NOT coalesce(dead, false)")
    kinds = {"job": "Job", "story": "Story", "comment": "Comment", "poll": "Poll", "pollopt": "PollOption"}

    def typename(get: Get) -> Column:
        out = F.lit(None)
        for a, b in kinds.items():
            out = F.when(get("type") == a, b).otherwise(out)
        return out

    many = lambda get: F.coalesce(F.size(get("kids")), F.lit(0)).cast("long")
    s = Source(spark, Schema(NEWS_SDL))
    shown = {
        "unixTime": "time",
        "url": lambda get: F.concat(F.lit(site), get("id").cast("string")),
        "submittedUrl": "url",
        "byUsername": "by",
        "commentsCount": lambda get: F.coalesce(get("descendants"), F.lit(0)),
        "childCount": lambda get: F.greatest(many(get), F.lit(0)),
    }
    s.vertex("Item", items, shown, typename=typename, order=["id"])
    s.vertex("User", users, {"unixCreatedAt": "created"}, order=["id"])
    ranked = lambda raw, n: raw.where("rank IS NOT NULL").orderBy("rank", "id").limit(n)
    s.root("FrontPage", lambda raw: ranked(raw, _FRONT))
    s.root("Top", lambda raw, max=None: raw.where("rank IS NOT NULL") if max is None else ranked(raw, max))
    s.root("Latest", lambda raw, max=None: raw.where("type = 'story'") if max is None else raw.where("type = 'story'").orderBy(F.desc("time"), F.desc("id")).limit(max))
    s.root("User", lambda raw, name: raw.where(raw["id"] == name))
    s.edge_keys(["Story", "Comment"], "byUser", [("by", "id")])
    s.edge_keys("Story", "comment", [("id", "parent")])
    s.edge_keys("Comment", "reply", [("id", "parent")])
    s.edge_keys("Comment", "parent", [("parent", "id")])
    s.edge_table("User", "submitted", lambda spark: users.select(F.col("id").alias("author"), F.explode("submitted").alias("sent")).join(items, F.col("sent") == items["id"]).drop("sent"), [("id", "author")])
    return s


# folders

_PLACE = {"String": "name? path?"}
FILES_SDL = schema_sdl(
    "OriginDirectory: [Directory]",
    vertex_sdl("Directory", **_PLACE, edges="out_Directory_ContainsFile: [File] out_Directory_Subdirectory: [Directory]"),
    vertex_sdl("File", interface=True, Int="size?", String="path? extension? name?", edges="in_Directory_ContainsFile: [Directory]"),
    vertex_sdl("BinaryFile", "File", Int="size?", String="path? extension? name?", edges="in_Directory_ContainsFile: [Directory]"),
    vertex_sdl("TextFile", "File", Int="size?", String="contents? path? extension? name?", edges="in_Directory_ContainsFile: [Directory] out_TextFile_HasLine: [NumberedTextLine]"),
    vertex_sdl("NumberedTextLine", Int="line_number?", String="trimmed_contents? contents?"),
)
_SKIP = (".git", ".vscode", "target")
_TEXT_FILES = ("", "txt", "md", "py", "rs", "toml", "json", "csv", "yml", "yaml", "graphql", "ron", "html", "js", "ts", "sql")


def _folders(spark: SparkSession, folder: str, whole: tuple[str, ...] = ()) -> list[str]:
    """Paths of all folders below one, its own being empty; those that are ``whole`` are files."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system, found = root.getFileSystem(spark._jsc.hadoopConfiguration()), [""]
    for at in found:
        for status in system.listStatus(spark._jvm.org.apache.hadoop.fs.Path(root, at) if at else root):
            name = status.getPath().getName()
            if status.isDirectory() and name not in _SKIP and not name.endswith(tuple(f".{e}" for e in whole)):
                found.append(f"{at}/{name}" if at else name)
    return found


def _first_line(spark: SparkSession, path: str) -> str:
    """Of a file, or of the first of a folder; read without a job."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted(str(s.getPath()) for s in (system.globStatus(place) or []) if s.isFile()) or sorted(str(s.getPath()) for s in system.listStatus(place) if s.isFile())
    java = spark._jvm.java.io
    reader = java.BufferedReader(java.InputStreamReader(system.open(spark._jvm.org.apache.hadoop.fs.Path(files[0])), "UTF-8")) if files else None
    try:
        return (reader.readLine() or "") if reader else ""
    finally:
        if reader:
            reader.close()


def files_source(spark: SparkSession, folder: str, whole: tuple[str, ...] = ()) -> Source:
    """A folder tree without .git, .vscode and target; folders, empty ones too, are listed on the driver, as Spark lists files.

    A folder with an extension of ``whole`` holds the parts of one file: it is that file, as large as its parts and without contents.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = F.lit(spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/")
    full = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    files = found.select(F.substring(full, F.length(base) + 1, F.length(full)).alias("path"), F.col("length").alias("size"), "content")
    files = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, _SKIP))))
    if whole:
        top = F.regexp_extract("path", rf"^(?:[^/]+/)*?[^/]*\.(?:{'|'.join(whole)})(?=/)", 0)
        parted = files.where(top != "").groupBy(top.alias("path")).agg(F.sum("size").alias("size"))
        files = files.where(top == "").unionByName(parted, allowMissingColumns=True)
    parts = F.split("path", "/")
    files = files.withColumns({"name": F.element_at(parts, -1), "holder": F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")})
    files = files.withColumn("extension", F.when(F.col("name").contains("."), F.substring_index("name", ".", -1)).otherwise(""))
    steps = F.split("holder", "/")
    chain = F.concat(F.array(F.lit("")), F.when(F.col("holder") != "", F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))).otherwise(F.array().cast("array<string>")))
    folders = files.select(F.explode(chain).alias("path")).union(spark.createDataFrame([(p,) for p in _folders(spark, folder, whole)], "path string")).distinct()
    folders = folders.select("path", F.substring_index("path", "/", -1).alias("name"), F.when(F.col("path") != "", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")).alias("above"))
    s = Source(spark, Schema(FILES_SDL))
    s.vertex("Directory", folders, order=["path"])
    is_text = lambda get: F.lower(get("extension")).isin(*_TEXT_FILES)
    s.vertex("File", files, {"contents": lambda get: get("content").cast("string")}, typename=lambda get: F.when(is_text(get), "TextFile").otherwise("BinaryFile"), order=["path"])
    s.vertex("NumberedTextLine", spark.createDataFrame([], "line_number bigint, contents string"), {"trimmed_contents": lambda get: F.trim(get("contents"))})
    s.root("OriginDirectory", lambda raw: raw.where("path = ''"))
    s.edge_keys("Directory", "out_Directory_Subdirectory", [("path", "above")])
    s.edge_keys("Directory", "out_Directory_ContainsFile", [("path", "holder")])
    s.edge_keys("File", "in_Directory_ContainsFile", [("holder", "path")])
    lines = lambda get: F.transform(F.split(F.regexp_replace(get("content").cast("string"), r"\r?\n\z", ""), r"\r?\n"), lambda x, i: F.struct((i + 1).cast("long").alias("line_number"), x.alias("contents")))
    s.edge_array("TextFile", "out_TextFile_HasLine", lines, ["content"])
    return s
