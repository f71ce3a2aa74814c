"""tessella: PySpark-native analytics for source trees and documentation corpora."""
