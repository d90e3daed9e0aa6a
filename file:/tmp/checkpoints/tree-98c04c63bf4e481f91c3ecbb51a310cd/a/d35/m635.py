x635