x397