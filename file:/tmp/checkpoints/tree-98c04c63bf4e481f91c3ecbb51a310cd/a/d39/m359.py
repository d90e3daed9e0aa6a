x359