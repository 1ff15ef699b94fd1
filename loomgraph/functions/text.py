"""Text, template and time functions over columns."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The markers of tool calls and of chat turns.
CALL_START, CALL_END = "<tool_call>\n", "\n</tool_call>"
CHAT_TEMPLATE = "<|im_start|>{role}\n{content}<|im_end|>\n"
GENERATION_PROMPT = "<|im_start|>assistant\n"


def between_markers(text: Column, start: str = CALL_START, end: str = CALL_END) -> Column:
    """What stands between two markers. Without either, the text itself; without the first only, all from a marker's length on; without the last only, all to the end."""
    s, e = F.locate(start, text), F.locate(end, text)
    first = F.when(s > 0, s + len(start)).otherwise(len(start) + 1)
    last = F.when(e > 0, e).otherwise(F.length(text) + 1)
    return F.when((s == 0) & (e == 0), text).otherwise(F.substring(text, first, F.greatest(last - first, F.lit(0))))


def wrap_list(text: Column) -> Column:
    """``{...}`` as a list of one object, others as they are."""
    return F.when(F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}")), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)


def clean_tool_calls(text: Column) -> Column:
    """A model's tool-call text as a JSON list: markers cut, calls parted by a tag joined, ``parameters`` named ``arguments``."""
    text = between_markers(text)
    for old, new in (("}}<|python_tag|>{", "}},{"), ("<|python_tag|>", ""), ("|>", ""), ('"parameters":', '"arguments":')):
        text = F.replace(text, F.lit(old), F.lit(new))
    return wrap_list(F.trim(text))


def render_template(template: str, **values: Column) -> Column:
    """``{name}`` in the template replaced by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def chat_line(role: Column, content: Column) -> Column:
    """A turn of the chat template. A null content is an empty one, a null role is ``user``, as ``message_role`` has it for chat services: no turn is lost."""
    role, content = F.coalesce(role, F.lit("user")), F.coalesce(content, F.lit(""))
    head, middle, tail = CHAT_TEMPLATE.replace("{content}", "{role}").split("{role}")
    return F.concat(F.lit(head), role, F.lit(middle), content, F.lit(tail))


def message_role(role: Column) -> Column:
    """The role a chat service knows: tool calls are ``tool``, tools and functions ``function``, what is unknown ``user``."""
    return F.when(role.isin("user", "system", "assistant"), role).when(role == "tool_call", "tool").when(role.isin("tool", "function"), "function").otherwise("user")


def timestamp_text(at: Column) -> Column:
    """A time as ``Thu Jan  1 00:00:00 1970``."""
    return F.concat(F.date_format(at, "EEE MMM "), F.lpad(F.dayofmonth(at).cast("string"), 2, " "), F.date_format(at, " HH:mm:ss yyyy"))


def timestamp_now() -> Column:
    return timestamp_text(F.current_timestamp())


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB in steps of 1000, two decimals."""
    scaled = lambda by, unit: F.concat(F.format_number(n / by, 2), F.lit(unit))
    return F.when(n < 1_000, F.concat(n.cast("string"), F.lit("B"))).when(n < 1_000_000, scaled(1_000, "KB")).when(n < 1_000_000_000, scaled(1_000_000, "MB")).otherwise(scaled(1_000_000_000, "GB"))


def keep_last(tokens: Column, n: int) -> Column:
    """The last ``n`` tokens of an array: prompts are cut at the left."""
    return F.when(F.size(tokens) > n, F.slice(tokens, -n, n)).otherwise(tokens)


def chat_template(messages: Column, template: str, **values: str) -> Column:
    """A Jinja chat template over an array of (role, content), for models whose template is more than ``chat_line``.

    It needs jinja2 on the workers; a batch of rows is rendered at a time.
    """

    @F.pandas_udf("string")
    def render(rows: pd.Series) -> pd.Series:
        import jinja2

        def raise_exception(text):
            raise jinja2.TemplateError(text)

        made = jinja2.Environment(trim_blocks=True, lstrip_blocks=True).from_string(template)
        made.globals["raise_exception"] = raise_exception
        return rows.map(lambda x: made.render(messages=list(x), **values))

    return render(messages)
