x226