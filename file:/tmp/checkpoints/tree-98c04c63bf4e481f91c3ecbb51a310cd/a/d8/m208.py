x208