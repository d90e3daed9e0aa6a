x398