x431