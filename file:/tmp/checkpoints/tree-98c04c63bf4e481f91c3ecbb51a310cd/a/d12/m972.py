x972