x910