x892