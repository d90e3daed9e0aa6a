x599