x307