x362