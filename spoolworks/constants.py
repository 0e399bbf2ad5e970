"""Fixed values that results must reproduce exactly."""

# --- fixed values: chat markup -------------------------------------------------
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
DEFAULT_SYSTEM_TEXT = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."
TOOLS_HEADER = (
    "\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\n"
    "You are provided with function signatures within <tools></tools> XML tags:\n<tools>"
)
TOOLS_FOOTER = (
    "\n</tools>\n\nFor each function call, return a json object with function name and arguments "
    'within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, '
    '"arguments": <args-json-object>}\n</tool_call>' + IM_END + "\n"
)

# --- fixed values: turn templates ------------------------------------------------
USER_TURN_TEMPLATE = "<start_of_turn>user\n{instruction}<end_of_turn>\n<start_of_turn>model\n"
MODEL_TURN_TEMPLATE = "{output}<end_of_turn>"
INLINE_IMAGE_PROMPT = "<image>User: Describe this image.\nAssistant: "
FIXED_IMAGE_PROMPT = "Describe this image."
DEFAULT_IMAGE_INSTRUCTION = "Describe this image in detail."

# --- fixed values: special tokens and label mask -----------------------------------
IGNORE_INDEX = -100
SPECIAL_TOKENS = {
    "<|endoftext|>": 151643,
    "<|im_start|>": 151644,
    "<|im_end|>": 151645,
    "<|object_ref_start|>": 151646,
    "<|object_ref_end|>": 151647,
    "<|box_start|>": 151648,
    "<|box_end|>": 151649,
    "<|quad_start|>": 151650,
    "<|quad_end|>": 151651,
    "<|vision_start|>": 151652,
    "<|vision_end|>": 151653,
    "<|vision_pad|>": 151654,
    "<|image_pad|>": 151655,
    "<|video_pad|>": 151656,
    "<tool_call>": 151657,
    "</tool_call>": 151658,
    "<|fim_prefix|>": 151659,
    "<|fim_middle|>": 151660,
    "<|fim_suffix|>": 151661,
    "<|fim_pad|>": 151662,
    "<|repo_name|>": 151663,
    "<|file_sep|>": 151664,
}
PAD_TOKEN_ID = 151643

# --- fixed values: field names looked up in caption datasets -------------------------
IMAGE_FIELDS = ["image", "img", "image_path", "filename"]
IMAGE_FIELD_HINTS = ["image", "img", "photo", "file"]
CAPTION_FIELDS = ["caption", "captions", "text", "sentence"]
CAPTION_FIELD_HINTS = ["caption", "text", "description", "sent"]
SPLIT_JOB_IMAGE_FIELDS = ["image", "img", "images"]
SPLIT_JOB_IMAGE_HINTS = ["image", "img", "photo"]
SPLIT_JOB_CAPTION_FIELDS = ["caption", "captions"]
SPLIT_JOB_CAPTION_HINTS = ["caption", "text"]

# --- fixed values: generated file names --------------------------------------------
CAPTION_SET = "flickr8k"
SPLIT_FILE_PATTERN = "{base}_{split}.json"
DEFAULT_DATA_FILE = "flickr8k_test_data.json"
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png"]

# --- fixed values: characters Python's str.strip() removes ---------------------------
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
