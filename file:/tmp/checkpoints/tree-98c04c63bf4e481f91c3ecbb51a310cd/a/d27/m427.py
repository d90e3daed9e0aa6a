x427