x737