x681