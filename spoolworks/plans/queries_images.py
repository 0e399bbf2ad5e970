"""Queries over caption records and image inventories."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..constants import DEFAULT_IMAGE_INSTRUCTION
from ..functions import chat as H
from ..functions import images as I
from ..operators import captions as C
from ..operators import projections as P
from ..operators.ranking import split_exact_ranked
from ..session import scratch_path
from ..sinks.files import copy_images as write_images
from ..sinks.files import drop_failed_copies, image_faults
from ..sources.files import scan_image_files
from .caption_data import flatten_caption_source, load_vision_records, prepare_vision_prompts, split_caption_records
from .catalog import query
from .queries_sampling import V_RANKED, V_SPLIT
from .standins import V_CAPTIONS, V_INVENTORY

DIR = "/data/images"


def files(t):
    """Inventory as a listing of full paths."""
    return t.inventory.select(F.concat(F.lit(f"{DIR}/"), "file_name").alias("path"), "decodes")


V_PATHS = f"""v_paths AS (
  SELECT doc_id, captions, concat('{DIR}/', regexp_replace(image, '^images/', '')) AS image_path, lang FROM v_captions)"""
V_FILES = f"v_files AS (SELECT concat('{DIR}/', file_name) AS path, decodes FROM v_inventory)"
FOUND = "image_path IN (SELECT path FROM v_files)"


def paths(t):
    return t.captions.select(
        "doc_id", "captions", I.normalize_image_path(F.col("image"), DIR).alias("image_path"), "lang"
    )


# ---- schema mapping -------------------------------------------------------------------------


@query(
    "qa_to_vlm",
    """SELECT conv_id, turn, text AS instruction, role AS output,
              concat('images/', md5(text), '_', md5(role), '.jpg') AS image FROM conversations""",
)
def _(t):
    raw = t.conversations.select("conv_id", "turn", F.col("text").alias("question"), F.col("role").alias("answer"))
    return P.qa_to_vlm(raw, ["conv_id", "turn"])


# images are missing for French, captions for German, both for the documents of src0 in those two
V_SPARSE = """v_sparse AS (
  SELECT doc_id, CASE WHEN lang <> 'fr' THEN concat('images/doc_', doc_id, CASE WHEN doc_id % 2 = 0 THEN '.jpg' ELSE '.gif' END) END AS image,
         CASE WHEN lang <> 'de' AND NOT (lang = 'fr' AND source = 'src0') THEN text END AS caption FROM documents)"""
V_FILLED = """v_filled AS (
  SELECT doc_id, coalesce(image, concat('flickr8k_', n, '.jpg')) AS image,
         coalesce(caption, concat('Image ', n, ' without a description')) AS caption, n
  FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM v_sparse
        WHERE image IS NOT NULL OR caption IS NOT NULL) q)"""


def sparse(t):
    suffix = F.when(F.col("doc_id") % 2 == 0, ".jpg").otherwise(".gif")
    image = F.concat(F.lit("images/doc_"), F.col("doc_id").cast("string"), suffix)
    no_caption = (F.col("lang") == "de") | ((F.col("lang") == "fr") & (F.col("source") == "src0"))
    return t.documents.select(
        "doc_id", F.when(F.col("lang") != "fr", image).alias("image"), F.when(~no_caption, F.col("text")).alias("caption")
    )


@query("fill_or_drop", "SELECT doc_id, image, caption, n FROM v_filled", (V_SPARSE, V_FILLED))
def _(t):
    filled = P.fill_or_drop(sparse(t), "doc_id")
    return filled.select(
        "doc_id", F.col("__image").alias("image"), F.col("__caption").alias("caption"), F.col("__n").alias("n")
    )


@query(
    "caption_to_vlm",
    f"""SELECT doc_id, '{DEFAULT_IMAGE_INSTRUCTION}' AS instruction, caption AS output,
         concat('images/', CASE WHEN image LIKE '%.jpg' THEN regexp_extract(image, '[^/]*$')
                                ELSE concat('flickr8k_', n, '.jpg') END) AS image FROM v_filled""",
    (V_SPARSE, V_FILLED),
)
def _(t):
    return P.caption_to_vlm(sparse(t), "doc_id", ["doc_id"])


@query(
    "caption_to_vlm_features",
    f"""SELECT doc_id, '{DEFAULT_IMAGE_INSTRUCTION}' AS instruction,
         concat('Image feature_', row_number() OVER (ORDER BY doc_id) - 1, ' description') AS output,
         concat('images/flickr8k_', row_number() OVER (ORDER BY doc_id) - 1, '.jpg') AS image FROM documents""",
)
def _(t):
    return P.caption_to_vlm(t.documents.select("doc_id", F.col("n_chars").alias("feature")), "doc_id", ["doc_id"])


@query(
    "caption_to_vlm_pairs",
    f"""SELECT doc_id, '{DEFAULT_IMAGE_INSTRUCTION}' AS instruction, text AS output,
         concat('images/flickr8k_', row_number() OVER (ORDER BY doc_id) - 1, '.jpg') AS image FROM documents""",
)
def _(t):
    pairs = t.documents.select("doc_id", F.col("text").alias("sentence1"), F.col("source").alias("sentence2"))
    return P.caption_to_vlm(pairs, "doc_id", ["doc_id"])


@query("resolve_fields", "SELECT doc_id, image, unnest(captions) AS caption FROM v_captions", (V_CAPTIONS,))
def _(t):
    odd = t.captions.select("doc_id", F.col("image").alias("photo_file"), F.col("captions").alias("Caption_List"))
    return flatten_caption_source(odd, ["doc_id"])


# ---- vision formats ---------------------------------------------------------------------------

CONVERSATION = """SELECT doc_id, 'user' AS r0, 'image' AS k0, image AS i0, 'text' AS k1, {} AS t1,
  'assistant' AS r1, 'text' AS k2, text AS t2
  FROM (SELECT doc_id, concat('images/doc_', doc_id, '.jpg') AS image, text FROM documents) q"""


def conversation_rows(t):
    return t.documents.select(
        "doc_id", F.concat(F.lit("images/doc_"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image"), "text"
    )


def flat(df):
    user, answer = F.col("messages")[0], F.col("messages")[1]
    return df.select(
        "doc_id", user["role"].alias("r0"), user["content"][0]["type"].alias("k0"), user["content"][0]["image"].alias("i0"),
        user["content"][1]["type"].alias("k1"), user["content"][1]["text"].alias("t1"),
        answer["role"].alias("r1"), answer["content"][0]["type"].alias("k2"), answer["content"][0]["text"].alias("t2"),
    )


@query("vlm_conversation", CONVERSATION.format(f"'{DEFAULT_IMAGE_INSTRUCTION}'"))
def _(t):
    rows = conversation_rows(t).withColumnRenamed("text", "caption").withColumn("text", F.lit(DEFAULT_IMAGE_INSTRUCTION))
    return flat(P.vlm_conversation(rows, ["doc_id"]))


@query("vlm_fixed_prompt", CONVERSATION.format("'Describe this image.'"))
def _(t):
    return flat(P.vlm_fixed_prompt(conversation_rows(t), ["doc_id"]))


@query("vlm_inline_prompt", "SELECT doc_id, concat('<image>User: Describe this image.\nAssistant: ', text) AS text FROM documents")
def _(t):
    return P.vlm_inline_prompt(conversation_rows(t), ["doc_id"])


@query("vlm_caption_only", "SELECT doc_id, text, '' AS strict_text FROM documents")
def _(t):
    rows = t.documents.select("doc_id", F.col("text").alias("output"))
    both = rows.withColumn("strict", P.first_present(rows, ["caption", "text"], ""))
    return P.vlm_caption_only(both, keep=["doc_id", "strict"]).withColumnRenamed("strict", "strict_text")


@query(
    "flatten_messages",
    f"SELECT doc_id, concat('user: {DEFAULT_IMAGE_INSTRUCTION}\nassistant: ', text) AS line FROM documents",
)
def _(t):
    rows = conversation_rows(t).withColumnRenamed("text", "caption").withColumn("text", F.lit(DEFAULT_IMAGE_INSTRUCTION))
    return P.vlm_conversation(rows, ["doc_id"]).select("doc_id", H.flatten_messages(F.col("messages")).alias("line"))


# ---- paths and names ----------------------------------------------------------------------------

V_RAW_PATHS = """v_raw AS (
  SELECT doc_id, CASE WHEN lang = 'en' THEN concat('images/doc_', doc_id, '.jpg')
                      WHEN lang = 'fr' THEN concat('images/images/doc_', doc_id, '.png')
                      WHEN lang = 'de' THEN concat('/abs/doc_', doc_id, '.gif') ELSE '' END AS p FROM documents)"""


def raw_paths(t):
    number = F.col("doc_id").cast("string")
    lang = F.col("lang")
    return t.documents.select(
        "doc_id",
        F.when(lang == "en", F.concat(F.lit("images/doc_"), number, F.lit(".jpg")))
        .when(lang == "fr", F.concat(F.lit("images/images/doc_"), number, F.lit(".png")))
        .when(lang == "de", F.concat(F.lit("/abs/doc_"), number, F.lit(".gif")))
        .otherwise("").alias("p"),
    )


STRIPPED = "CASE WHEN starts_with(p, 'images/') THEN substr(p, 8) ELSE p END"


@query(
    "normalize_image_path",
    f"""SELECT doc_id,
      CASE WHEN p = '' THEN 'base' WHEN starts_with(p, '/') THEN p ELSE concat('base/', {STRIPPED}) END AS loader,
      CASE WHEN starts_with(p, '/') THEN p ELSE concat('base/', {STRIPPED}) END AS trainer,
      CASE WHEN starts_with(p, '/') THEN p ELSE concat('base/', p) END AS joined,
      CASE WHEN starts_with(p, 'images/') THEN concat('base/', p) ELSE p END AS input_dir FROM v_raw""",
    (V_RAW_PATHS,),
)
def _(t):
    rules = ["loader", "trainer", "joined", "input_dir"]
    return raw_paths(t).select("doc_id", *[I.normalize_image_path(F.col("p"), "base", r).alias(r) for r in rules])


@query(
    "image_file_name",
    """SELECT doc_id, concat(lang, '_', lpad(CAST(doc_id AS VARCHAR), CAST(greatest(5, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0'), '.jpg') AS split_name,
      CASE WHEN p LIKE '%.jpg' OR p LIKE '%.png' THEN regexp_extract(p, '[^/]*$') ELSE concat('flickr8k_', doc_id, '.jpg') END AS kept_name,
      concat(md5(p), '_', md5(lang), '.jpg') AS pair_name
      FROM v_raw JOIN documents USING (doc_id)""",
    (V_RAW_PATHS,),
)
def _(t):
    rows = raw_paths(t).join(t.documents.select("doc_id", "lang"), "doc_id")
    return rows.select(
        "doc_id", I.split_image_name(F.col("lang"), F.col("doc_id")).alias("split_name"),
        I.kept_image_name(F.col("p"), F.col("doc_id")).alias("kept_name"),
        I.question_image_name(F.col("p"), F.col("lang")).alias("pair_name"),
    )


# ---- caption lists ---------------------------------------------------------------------------------


@query("explode_captions", "SELECT doc_id, image, lang, unnest(captions) AS caption FROM v_captions", (V_CAPTIONS,))
def _(t):
    return C.explode_captions(t.captions, "captions")


@query("first_caption", "SELECT doc_id, image, captions[1] AS caption FROM v_captions", (V_CAPTIONS,))
def _(t):
    return C.first_caption(t.captions, "captions").select("doc_id", "image", "caption")


# ---- existence ---------------------------------------------------------------------------------------

IMAGE_VIEWS = (V_CAPTIONS, V_INVENTORY, V_PATHS, V_FILES)


@query("semi_join_images", f"SELECT doc_id, image_path FROM v_paths WHERE {FOUND}", IMAGE_VIEWS)
def _(t):
    return C.semi_join_images(paths(t).select("doc_id", "image_path"), files(t))


@query("anti_join_missing", f"SELECT doc_id, image_path FROM v_paths WHERE NOT ({FOUND})", IMAGE_VIEWS)
def _(t):
    return C.anti_join_missing(paths(t).select("doc_id", "image_path"), files(t))


@query(
    "has_image_left_join",
    f"SELECT doc_id, image_path, {FOUND} AS has_image, CASE WHEN {FOUND} THEN image_path END AS image FROM v_paths",
    IMAGE_VIEWS,
)
def _(t):
    return C.has_image_left_join(paths(t).select("doc_id", "image_path"), files(t))


@query("supported_image_type", "SELECT doc_id, source FROM documents WHERE source IN ('src0', 'src2')")
def _(t):
    return C.supported_image_type(t.documents.select("doc_id", "source"), "source", ("src0", "src2"))


def contents(t):
    """File bytes made from the tables: a JPEG start and the text for files that decode, else the text."""
    rows = t.table("labels").join(t.documents.select("doc_id", "text"), "doc_id")
    start = F.lit(b"\xff\xd8\xff\xe0")
    body = F.encode("text", "UTF-8")
    return rows.select(
        F.concat(F.lit(f"{DIR}/doc_"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"),
        F.when(F.col("quality") == 1, F.concat(start, body)).otherwise(body).alias("content"),
    )


@query("valid_image", "SELECT path FROM v_files WHERE decodes", (V_INVENTORY, V_FILES))
def _(t):
    return C.valid_image(contents(t)).select("path")


@query(
    "load_vision_records",
    f"""SELECT doc_id, image_path, '{DEFAULT_IMAGE_INSTRUCTION}' AS text, unnest(captions) AS caption FROM v_paths
        WHERE image_path IN (SELECT path FROM v_files WHERE decodes)""",
    IMAGE_VIEWS,
)
def _(t):
    records = t.captions.select("doc_id", "image", "captions")
    return load_vision_records(records, files(t), DIR, contents(t), keep=["doc_id"])


def image_folder(t):
    """A folder of real files made from the tables, by the sink that writes bytes under generated names."""
    folder = scratch_path(t.spark, "images")
    bodies = contents(t).select(F.substring_index("path", "/", -1).alias("dest"), "path", "content")
    return folder, write_images(bodies, folder, src="path", content="content")


@query(
    "load_image_files",
    f"""SELECT doc_id, '{DEFAULT_IMAGE_INSTRUCTION}' AS text, unnest(captions) AS caption FROM v_paths
        WHERE image_path IN (SELECT path FROM v_files WHERE decodes)""",
    IMAGE_VIEWS,
)
def _(t):
    folder, _ = image_folder(t)
    listing = scan_image_files(t.spark, folder).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    root = re.sub("^file:/+", "/", folder)
    records = t.captions.select("doc_id", "image", "captions")
    rows = load_vision_records(records, listing, root, keep=["doc_id"], check_heads=True)
    return rows.select("doc_id", "text", "caption")


@query(
    "has_image_decodes",
    f"""SELECT doc_id, image_path IN (SELECT path FROM v_files WHERE decodes) AS has_image FROM v_paths""",
    IMAGE_VIEWS,
)
def _(t):
    folder, _ = image_folder(t)
    listing = scan_image_files(t.spark, folder).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    root = re.sub("^file:/+", "/", folder)
    records = t.captions.select("doc_id", F.replace("image", F.lit("images/"), F.lit("")).alias("image"), F.lit("x").alias("instruction"), F.lit("y").alias("output"))
    return prepare_vision_prompts(records, listing, root, "{instruction}", "{output}", keep=["doc_id"], check_heads=True).select("doc_id", "has_image")


V_PLACED = f"""v_placed AS (
  SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY rank) - 1 AS index,
         concat('/in/images/doc_', doc_id, '.jpg') AS src FROM v_split)"""


@query(
    "split_caption_records",
    f"""SELECT doc_id, split, index, '{DEFAULT_IMAGE_INSTRUCTION}' AS instruction, text AS output,
          concat('images/', split, '_', lpad(CAST(index AS VARCHAR), CAST(greatest(5, length(CAST(index AS VARCHAR))) AS INTEGER), '0'), '.jpg') AS image, src,
          concat(split, '_', lpad(CAST(index AS VARCHAR), CAST(greatest(5, length(CAST(index AS VARCHAR))) AS INTEGER), '0'), '.jpg') AS dest
        FROM v_placed JOIN documents USING (doc_id)
        WHERE src IN (SELECT concat('/in/images/', file_name) FROM v_inventory)""",
    (V_RANKED, V_SPLIT, V_INVENTORY, V_PLACED),
)
def _(t):
    records = t.documents.select(
        "doc_id", F.concat(F.lit("images/doc_"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image"),
        F.col("text").alias("caption"),
    )
    listing = t.inventory.select(F.concat(F.lit("/in/images/"), "file_name").alias("path"))
    return split_caption_records(records, listing, "doc_id", "/in")


def manifest_copies(t):
    """The folder, manifest and statuses of whole texts copied under the names of their lengths."""
    # equal lengths give equal names, so the first writer by document wins; the listing says what was written
    rows = split_exact_ranked(t.documents.select("doc_id", "n_chars"), "doc_id")
    source = F.concat(F.lit("/in/doc_"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    manifest = C.image_manifest(rows, source, index="n_chars").select("dest", "src", "split", "doc_id")
    body = F.concat(F.lit(b"\xff\xd8\xff\xe0"), F.encode("text", "UTF-8"))
    folder = scratch_path(t.spark, "copies")
    bodies = manifest.join(t.documents.select("doc_id", body.alias("content")), "doc_id")
    return folder, manifest, write_images(bodies, folder, content="content", order_key="doc_id")


@query(
    "write_image_manifest",
    """SELECT dest, src, split, 4 + octet_length(encode(text)) AS length FROM (
         SELECT *, row_number() OVER (PARTITION BY dest ORDER BY doc_id) AS rn FROM (
         SELECT doc_id, split, text, concat('/in/doc_', doc_id, '.jpg') AS src,
                concat(split, '_', lpad(CAST(n_chars AS VARCHAR), CAST(greatest(5, length(CAST(n_chars AS VARCHAR))) AS INTEGER), '0'), '.jpg') AS dest
         FROM v_split JOIN documents USING (doc_id)) a) b WHERE rn = 1""",
    (V_RANKED, V_SPLIT),
)
def _(t):
    folder, manifest, copied = manifest_copies(t)
    listed = scan_image_files(t.spark, folder).select(F.substring_index("path", "/", -1).alias("dest"), "length")
    return drop_failed_copies(manifest, copied).select("dest", "src", "split").join(listed, "dest")


@query(
    "copy_image_files",
    """SELECT concat('doc_', doc_id, '.jpg') AS src, concat('copy_', doc_id, '.jpg') AS dest,
              CASE WHEN doc_id % 3 = 0 THEN 'missing' ELSE 'written' END AS status FROM labels""",
)
def _(t):
    folder, _ = image_folder(t)
    number = F.col("doc_id").cast("string")
    known = F.when(F.col("doc_id") % 3 == 0, F.lit("gone_")).otherwise(F.lit("doc_"))
    manifest = t.table("labels").select(
        F.concat(F.lit(f"{folder}/"), known, number, F.lit(".jpg")).alias("src"), F.concat(F.lit("copy_"), number, F.lit(".jpg")).alias("dest")
    )
    copied = write_images(manifest, scratch_path(t.spark, "copied"))
    return copied.select(F.replace(F.substring_index("src", "/", -1), F.lit("gone_"), F.lit("doc_")).alias("src"), "dest", "status")


def _be(n):
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def _le(n):
    return F.unhex(F.format_string("%02X%02X%02X%02X", *[F.shiftright(n, 8 * i).bitwiseAND(255) for i in range(4)]))


def _chunk(kind, body):
    """A PNG chunk: length, type, body and checksum."""
    named = F.concat(F.lit(kind), body)
    return F.concat(_be(F.octet_length(body)), named, _be(F.crc32(named)))


def made_images(t):
    """Images in three containers around whole texts, by turns whole, cut short, changed in one bit, or no image."""
    text, kind = F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.col("doc_id") % 8
    header = _chunk(b"IHDR", F.lit(bytes.fromhex("00000001000000010800000000")))
    png = F.concat(F.lit(b"\x89PNG\r\n\x1a\n"), header, _chunk(b"IDAT", text), _chunk(b"IEND", F.lit(b"")))
    # the lowest bit of the last checksum byte of the data chunk
    at = F.octet_length(png) - 13
    bit = F.unhex(F.format_string("%02X", F.conv(F.hex(F.substring(png, at + 1, F.lit(1))), 16, 10).cast("int").bitwiseXOR(1)))
    flipped = F.concat(F.substring(png, F.lit(1), at), bit, F.substring(png, at + 2, F.octet_length(png)))
    frame, scan = "ffd8ffe000040000ffc0000b080001000101011100", "ffda0008010100003f00"
    jpeg = F.concat(F.lit(bytes.fromhex(frame + scan)), text, F.lit(b"\xff\xd9"))
    coded = F.concat(F.lit(bytes.fromhex("0000009d012a01000100")), text)
    body = F.concat(F.lit(b"WEBPVP8 "), _le(F.octet_length(coded)), coded, F.when(F.octet_length(coded) % 2 == 1, F.lit(b"\0")).otherwise(F.lit(b"")))
    webp = F.concat(F.lit(b"RIFF"), _le(F.octet_length(body)), body)

    def cut(image, n):
        return F.substring(image, F.lit(1), F.octet_length(image) - n)

    content = (
        F.when(kind == 0, png).when(kind == 1, cut(png, 3)).when(kind == 2, flipped).when(kind == 3, jpeg).when(kind == 4, cut(jpeg, 1))
        .when(kind == 5, webp).when(kind == 6, cut(webp, 2)).otherwise(text)
    )
    return t.documents.select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".img")).alias("path"), content.alias("content"))


WHOLE = "SELECT concat('doc_', doc_id, '.img') AS path, CASE doc_id % 8 WHEN 2 THEN 'bad checksum' WHEN 7 THEN 'no known format' ELSE CASE WHEN doc_id % 8 IN (1, 4, 6) THEN 'truncated' END END AS fault FROM documents"


@query("valid_image_structure", WHOLE)
def _(t):
    return image_faults(made_images(t), content="content")


@query("valid_image_files", WHOLE)
def _(t):
    """The same images as files, read from where they lie."""
    folder = scratch_path(t.spark, "made-images")
    write_images(made_images(t).withColumn("dest", F.col("path")), folder, src="path", content="content")
    found = image_faults(scan_image_files(t.spark, folder))
    return found.select(F.substring_index("path", "/", -1).alias("path"), "fault")
