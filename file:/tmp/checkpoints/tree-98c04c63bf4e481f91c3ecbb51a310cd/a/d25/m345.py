x345