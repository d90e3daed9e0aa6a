x488