"""String, path and hash functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw layout types and the three classes they are exported as.
LAYOUT_TYPES = {
    "text_plain": "plain_text",
    "text_plane": "plain_text",
    "title": "plain_text",
    "section_header": "plain_text",
    "list_item": "plain_text",
    "caption": "plain_text",
    "page_header": "plain_text",
    "page_footer": "plain_text",
    "abstract": "plain_text",
    "keywords": "plain_text",
    "footnote": "plain_text",
    "handwriting": "plain_text",
    "table_of_contents_entry": "plain_text",
    "text_inline_math": "plain_text",
    "formula": "plain_text",
    "music_sheet": "plain_text",
    "chemical_formula_content": "plain_text",
    "publishing_info": "plain_text",
    "signature": "plain_text",
    "stamp": "plain_text",
    "table": "table",
    "figure": "image",
    "picture": "image",
    "flowchart": "image",
    "chart": "image",
    "chart_bar": "image",
    "chart_pie": "image",
    "chart_line": "image",
    "chart_area": "image",
    "chart_scatter": "image",
    "chart_radar": "image",
    "chart_mixed": "image",
    "diagram": "image",
    "diagram_functional_block": "image",
    "diagram_flowchart": "image",
    "diagram_characteristic_curve": "image",
    "diagram_timing": "image",
    "diagram_circuit": "image",
    "diagram_3d_schematic": "image",
    "diagram_appearance": "image",
    "diagram_pin": "image",
    "diagram_layout": "image",
    "diagram_engineering_drawing": "image",
    "diagram_data_structure": "image",
    "diagram_sampling": "image",
    "diagram_functional_register": "image",
    "diagram_marking": "image",
}

# The raw types of office document codes, and of the placeholders and shapes of slides, by their names.
OFFICE_TYPES = {"T01": "title", "T02": "title", "T03": "text_plain", "T04": "list_item", "V01": "table", "V02": "chart", "V03": "digram", "V04": "picture", "V05": "figure"}
PLACEHOLDER_TYPES = {"TITLE": "title", "SUBTITLE": "subtitle", "SLIDE_NUMBER": "slide_number", "TABLE": "table", "HEADER": "header"}
SHAPE_TYPES = {"AUTO_SHAPE": "text", "GROUP": "text", "PICTURE": "figure", "CHART": "chart", "TABLE": "table", "TEXT_BOX": "text"}

# Prompts by task or class.
PROMPTS = {
    "recognition": "Read text in the image.",
    "base_kie_bbox": "Extract information from the image. Return the result in the following structured JSON format (formatted with zero-space indentation and without newlines), filling in both <|value|> and <|bbox|>:",
    "base_kie_no_bbox": "Extract information from the image. Return the result in the following structured JSON format (formatted with zero-space indentation and without newlines), filling in <|value|>:",
    "post_handwritten_plain_text": "Extract information from the image. Return the result in the following structured JSON format (formatted with zero-space indentation and without newlines), filling in both <|value|> and <|bbox|>. Read from left to right, top to bottom:",
    "base_layout_reading_order": "Extract all layout elements. Reading order must be preserved.",
    "base_layout_no_reading_order": "Extract all layout elements. Reading order does not matter.",
    "plain_text": "Read text in the image.",
    "table": "Parse the table in the image.",
    "image": "Read text in the image.",
}

# Class names of a layout corpus and the raw types they stand for.
DOCUMENT_CLASSES = {
    "Caption": "caption",
    "Footnote": "footnote",
    "Formula": "formula",
    "List-item": "list_item",
    "Page-footer": "page_footer",
    "Page-header": "page_header",
    "Picture": "figure",
    "Section-header": "section_header",
    "Table": "table",
    "Text": "text_plane",
    "Title": "title",
}


def mapping(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def layout_type(c: Column) -> Column:
    """The exported class of a raw type; an unknown type stays."""
    return F.coalesce(mapping(LAYOUT_TYPES)[c], c)


def document_class(c: Column) -> Column:
    """The raw type of a class name; an unknown one is other."""
    return F.coalesce(mapping(DOCUMENT_CLASSES)[c], F.lit("other"))


def office_type(c: Column) -> Column:
    """The raw type of an office document code, null for others."""
    return mapping(OFFICE_TYPES)[c]


def slide_type(placeholder: Column, shape: Column) -> Column:
    """The class of a slide's shape: by its placeholder, else by its kind; null for others."""
    return F.coalesce(mapping(PLACEHOLDER_TYPES)[placeholder], mapping(SHAPE_TYPES)[shape])


def prompt(c: Column) -> Column:
    return mapping(PROMPTS)[c]


def shard_levels(rows: Column) -> Column:
    return F.when(rows < 10_000, 0).when(rows < 2_500_000, 1).otherwise(2)


def shard_path(base: Column, digest: Column, levels: Column, ext: Column | str = "jpg") -> Column:
    ext = F.lit(ext) if isinstance(ext, str) else ext
    name = F.concat(digest, F.lit("."), ext)
    a, b = F.substring(digest, 1, 2), F.substring(digest, 3, 2)
    return F.when(levels == 0, F.concat_ws("/", base, name)).when(levels == 1, F.concat_ws("/", base, a, name)).otherwise(F.concat_ws("/", base, a, b, name))


def absolute_path(path: Column, base: str) -> Column:
    """Null and empty paths stay."""
    return F.when(F.length(path) > 0, F.concat(F.lit(base.rstrip("/") + "/"), path)).otherwise(path)


def last_parts(path: Column, n: int = 2) -> Column:
    return F.substring_index(path, "/", -n)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def last_id(path: Column) -> Column:
    return F.substring_index(stem(path), "_", -1)


def url_to_filename(url: Column) -> Column:
    name = F.substring_index(F.substring_index(url, "/", -1), "?", 1)
    name = F.regexp_replace(name, r'[<>:"/\\|?*]', "_")
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def hive_value(path: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(path, f"(?:^|/){key}=([^/]+)", 1), F.lit(""))


def extract_otsl(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, r"(?s)<otsl>.*?</otsl>", 0)), F.lit(""))


def tag_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"</?[\p{L}_]+>")), F.lit(0))


def first_integer(text: Column) -> Column:
    return F.regexp_extract(text, r"\d+", 0)


def tidy(text: Column) -> Column:
    """White space runs are one space, none at the ends, single quotes are double."""
    return F.replace(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", ""), F.lit("'"), F.lit('"'))


def repair_range(text: Column) -> Column:
    """An unbalanced bracket is closed or opened, two numbers apart are a range, ul is uL."""
    opened, closed = F.instr(text, "[") > 0, F.instr(text, "]") > 0
    t = F.when(opened & ~closed, F.concat(text, F.lit("]"))).when(closed & ~opened, F.concat(F.lit("["), text)).otherwise(text)
    return F.regexp_replace(F.regexp_replace(t, r"(\d+(?:\.\d+)?) +(\d+(?:\.\d+)?)", "$1~$2"), "ul", "uL")


def first_period(text: Column) -> Column:
    """If the text without spaces repeats a phrase, the phrase as it first stands; else the text."""
    bare = F.regexp_replace(text, r"\s+", "")
    # a text is a repetition of its first n characters if it stands again in its double, n behind its begin
    period = F.call_function("locate", bare, F.concat(bare, bare), F.lit(2)) - 1
    solid = F.filter(F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike(r"^\S"), i + 1).otherwise(0)), lambda i: i > 0)
    cut = F.substring(text, F.lit(1), F.try_element_at(solid, F.greatest(period, F.lit(1))))
    return F.when((period > 0) & (period < F.length(bare)), F.trim(cut)).otherwise(text)


def is_iso_date(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$")


def plain_spaces(text: Column) -> Column:
    """Ideographic spaces are spaces, zero-width ones go."""
    return F.translate(text, "　​", " ")


def short_time(iso: Column) -> Column:
    """Month-day and time of an ISO time; anything else stays."""
    return F.coalesce(F.date_format(F.try_to_timestamp(iso), "MM-dd HH:mm"), iso)


def image_path_of_url(url: Column, prefix: str = "") -> Column:
    """The d parameter of an image URL without a prefix."""
    return F.regexp_replace(F.regexp_extract(url, r"[?&]d=([^&]*)", 1), f"^{prefix}", "")


def template(head: str, items: Column, tail: str = "", item: str = "- ") -> Column:
    """A prompt that lists keys, one a line."""
    return F.concat(F.lit(head), F.array_join(F.transform(items, lambda x: F.concat(F.lit("\n" + item), x)), ""), F.lit(tail))
