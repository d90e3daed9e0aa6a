x343