x638