"""Canonical record types, defined once for all operators."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _D, _L, _I, _B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()

MESSAGE = _struct(("role", _S), ("content", _S))
TOOL_CALL = _struct(("name", _S), ("arguments", _S))
TOOL_MESSAGE = _struct(("role", _S), ("content", _S), ("tool_calls", T.ArrayType(TOOL_CALL)))
CONTENT_PART = _struct(("type", _S), ("text", _S), ("image", _S))
VISION_MESSAGE = _struct(("role", _S), ("content", T.ArrayType(CONTENT_PART)))

INSTRUCTION = _struct(("instruction", _S), ("input", _S), ("output", _S))
VISION_RECORD = _struct(("instruction", _S), ("output", _S), ("image", _S))
VISION_LOADED = _struct(("image_path", _S), ("text", _S), ("caption", _S))
PROMPT = _struct(("text", _S), ("prompt", _S), ("response", _S), ("has_image", _B), ("image", _S))
CHAT = _struct(("messages", T.ArrayType(MESSAGE)))
TOKENS = _struct(
    ("input_ids", T.ArrayType(_I)), ("attention_mask", T.ArrayType(_I)), ("labels", T.ArrayType(_I))
)
SCALAR = _struct(("run", _S), ("tag", _S), ("step", _L), ("value", _D))
DEVICE_SAMPLE = _struct(
    ("ts", T.TimestampType()), ("id", _I), ("name", _S),
    ("total", _D), ("reserved", _D), ("allocated", _D), ("free", _D),
)
PARAMETER = _struct(("name", _S), ("numel", _L), ("trainable", _B))

LOG_ENTRY = _struct(
    ("epoch", _D), ("grad_norm", _D), ("learning_rate", _D), ("loss", _D), ("step", _L),
    ("total_flos", _D), ("train_loss", _D), ("train_runtime", _D),
    ("train_samples_per_second", _D), ("train_steps_per_second", _D),
)
TRAINER_STATE = _struct(
    ("epoch", _D), ("global_step", _L), ("max_steps", _L), ("logging_steps", _D), ("save_steps", _L),
    ("num_train_epochs", _L), ("train_batch_size", _L), ("total_flos", _D),
    ("log_history", T.ArrayType(LOG_ENTRY)),
)
