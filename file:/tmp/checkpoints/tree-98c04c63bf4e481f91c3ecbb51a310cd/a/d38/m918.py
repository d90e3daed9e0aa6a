x918