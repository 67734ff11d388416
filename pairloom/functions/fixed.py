"""Results depend on these texts exactly, so they are stated plainly."""

# Prompts and templates (fixed values).
INSTRUCTION = "以下の漢字混じり文をカタカナに変換してください："
SEQ2SEQ_INSTRUCTION = "漢字をカタカナに変換してください。"
SEQ2SEQ_INPUT = "入力: "
SEQ2SEQ_OUTPUT = "出力: "
ALPACA_HEAD = (
    "Below is an instruction that describes a task, paired with an input that provides "
    "further context. Write a response that appropriately completes the request."
)
ALPACA_INSTRUCTION = "### Instruction:"
ALPACA_INPUT = "### Input:"
ALPACA_RESPONSE = "### Response:"

# Tags around the working out and the solution (fixed values).
WORK_START = "<start_working_out>"
WORK_END = "<end_working_out>"
SOLUTION_START = "<SOLUTION>"
SOLUTION_END = "</SOLUTION>"
THINK_TAGS = ("<think>", "</think>")
ANSWER_MARK = "####"
SYSTEM_PROMPT = (
    "You are given a problem.\n"
    "Think about the problem and provide your working out.\n"
    f"Place it between {WORK_START} and {WORK_END}.\n"
    f"Then, provide your solution between {SOLUTION_START}{SOLUTION_END}"
)

# Chat markers (fixed values).
BOS = "<bos>"
TURN_START = "<start_of_turn>"
TURN_END = "<end_of_turn>"
USER_HEADER = f"{TURN_START}user\n"
MODEL_HEADER = f"{TURN_START}model\n"
EOS = "<|endoftext|>"
IGNORED_LABEL = -100

# Character lists (fixed values).
PUNCTUATION = "。、！？・「」（）"
UNWANTED_SYMBOLS = "!@#$%^&*()_+=[]{}|;:<>?/~`\"'\\"

# Phrases that mark an explanation instead of a conversion (fixed values).
EXPLANATIONS = (
    "変換すると", "カタカナにすると", "読み方は", "以下のようになります",
    "答えは", "結果は", "変換結果", "カタカナ表記",
)

# Phrases that cost points each time they occur (fixed values).
UNWANTED_PHRASES = (
    "変換すると", "カタカナで", "答えは", "結果は", "以下", "次のように",
    "変換結果", "答え", "回答", "です", "である", "ます", "変換", "して",
    "という", "になります", "は", "が", "を", "に", "の", "と", "だ",
    "れる", "られる", "される", "できる", "思う", "考える", "でしょう",
)

# Report wording (fixed values).
REPORT_TOTAL = "📊 総処理時間: %.3f秒"
REPORT_MEAN = "⚡ 平均処理時間: %.3f秒/文"
REPORT_SPEED = "🚀 平均処理速度: %.1f 文字/秒"
REPORT_INPUT = "入力: "
REPORT_OUTPUT = "出力: "
REPORT_ROW_TIME = "推論時間: %.3f秒"
REPORT_ROW_SPEED = "処理速度: %.1f 文字/秒"
ERROR_PREFIX = "エラー: "
